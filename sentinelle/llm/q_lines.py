"""op3: every document without cross-site boilerplate lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.llm import lines
from sentinelle.session import table


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("line_n").alias("n_lines"), F.col("line_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = {
    "op3_line_spread": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, coalesce(source, '') AS site, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS r(i)),
w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM l),
s AS (SELECT line, count(DISTINCT site) AS sites, min((doc_id, i)) AS first FROM w WHERE word GROUP BY line),
k AS (SELECT w.*, coalesce(word AND sites >= {lines.SPREAD} AND (doc_id, i) <> first, false) AS gone FROM w LEFT JOIN s USING (line))
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT rid, any_value(doc_id) AS doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY rid)
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM d WHERE ls IS NULL
"""
}
QUERIES = {"op3_line_spread": op3_line_spread}
