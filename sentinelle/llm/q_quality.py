"""op4: the quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.llm import quality
from sentinelle.session import table


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names])


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))

#: RE2's classes are spelled out; chr(11) and chr(12) are the two blanks SQL strings have no escape for.
ORACLE = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS n_stops
      FROM w LEFT JOIN n USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.25
       AND n_stops / n_words >= 0.02 AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5
       AND n_repeat_words / n_words <= 0.5 AS kept
FROM b
"""
}
QUERIES = {"op4_quality_rules": op4_quality_rules}
