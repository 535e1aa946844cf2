"""op2: every document held against every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.llm import decontam
from sentinelle.session import table


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    judged = decontam.judged(index, decontam.search(index, table(spark, sf_dir, "benchmark")))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"

ORACLE = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
b AS (SELECT item_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS g
      FROM (SELECT item_id, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - k + 2)) AS r(i)),
g AS (SELECT rid, k, i, array_to_string(ws[i:i+k-1], ' ') AS g
      FROM d, (SELECT DISTINCT k FROM q) AS ks, unnest(range(1, len(ws) - k + 2)) AS r(i) WHERE len(ws) >= k),
m AS (SELECT rid, item_id, i, k FROM g JOIN q USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""
}
QUERIES = {"op2_decontaminate": op2_decontaminate}
