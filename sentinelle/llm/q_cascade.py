"""op6: every page's URL judged by the filter rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentinelle.llm import cascade
from sentinelle.session import table

# The rules, as (verdict, host, path start).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLE = {
    "op6_url_filter": rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES {_RULES}) AS t(v, rh, rp)),
m AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m USING (rid)
"""
}
QUERIES = {"op6_url_filter": op6_url_filter}
