"""op8: every document with the licence that it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.llm import licences
from sentinelle.session import table


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence", F.round("dice", 6).alias("dice"))


_TEMPLATES = ", ".join(f"({k}, '{name}', '{' '.join(licences.normal(text))}')" for k, (name, text) in enumerate(licences.TEMPLATES))
_CUT = r"regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: Stretches begin and end with a bigram of the template; starts without enough of them near by are left out, as in Spark.
ORACLE = {
    "op8_licence_scan": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CUT} AS ws FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
p AS (SELECT k, name, string_split(body, ' ') AS ws FROM (VALUES {_TEMPLATES}) AS t(k, name, body)),
pb AS (SELECT k, any_value(len(ws) - 1) AS n, ws[i] || ' ' || ws[i+1] AS g, count(*) AS c FROM p, unnest(range(1, len(ws))) AS r(i) GROUP BY k, g),
b AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] AS g FROM d, unnest(range(1, len(ws))) AS r(i)),
h AS (SELECT rid, k, n, i, g, c, row_number() OVER (PARTITION BY rid, k ORDER BY i) AS o FROM b JOIN pb USING (g)),
s AS (SELECT a.rid, a.k, a.i, a.o FROM h AS a JOIN h AS z
      ON z.rid = a.rid AND z.k = a.k AND z.o = a.o + greatest(1, ceil(a.n * {licences.ALIKE} / (2 - {licences.ALIKE}) - 1e-9)) - 1
      WHERE z.i - a.i < floor(a.n * (2 - {licences.ALIKE}) / {licences.ALIKE} + 1e-9)),
w AS (SELECT s.rid, s.k, s.i, h.i AS j, h.n, h.c, row_number() OVER (PARTITION BY s.rid, s.k, s.i, h.g ORDER BY h.i) AS r
      FROM s JOIN h ON h.rid = s.rid AND h.k = s.k AND h.i >= s.i AND h.i - s.i < floor(h.n * (2 - {licences.ALIKE}) / {licences.ALIKE} + 1e-9)),
m AS (SELECT rid, k, 2 * sum(CASE WHEN r <= c THEN 1 ELSE 0 END) OVER (PARTITION BY rid, k, i ORDER BY j) / (n + j - i + 1) AS dice FROM w),
f AS (SELECT rid, k, max(dice) AS dice FROM m GROUP BY rid, k HAVING max(dice) >= {licences.ALIKE}),
x AS (SELECT rid, k, dice, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, k) AS r FROM f)
SELECT doc_id, name AS licence, round(dice, 6) AS dice FROM d LEFT JOIN (SELECT rid, k, dice FROM x WHERE r = 1) USING (rid) LEFT JOIN p USING (k)
"""
}
QUERIES = {"op8_licence_scan": op8_licence_scan}
