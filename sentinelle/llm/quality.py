"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Text metrics are built-in array and string functions over the whole text; `Rule` rows name a metric and the
range it must keep, and `verdict` turns the table into a single boolean expression. No user function runs.

Defined cases: a null or blank text has no words (every count 0, base rules fail); a text without enough words
for a ratio gets ratio 0; repeated rows are judged one by one; extra columns pass through, and metrics come under a
prefix, where they replace columns of the same names (name another prefix to keep both); `kept` returns its input's
columns untouched, whatever their names. Very long texts are measured whole, in memory that follows the text; values equal
to a bound keep it; empty tables stay empty. Equal windows are found by 64-bit hashes and then compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinelle.llm import storage

WHITE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is it that was for on are with as by be this at from or an a
le la les de des du et en un une que qui dans pour sur au
der die das und den von zu im mit sich des auf für ist ein eine nicht
el los las que y por con para una se del es no lo
"""


@dataclass(frozen=True)
class Rule:
    """`metric` must lie in [low, high]; a bound of None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word (symbols, stop words) or per line (repeated lines).
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=1.5, high=25.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_word_ratio", high=0.5),
)


def with_metrics(docs: DataFrame, text: str = "text", p: str = "q_") -> DataFrame:
    """`docs` with the metrics of `text` in columns that start with `p`.

    Each array is made in a projection of its own, so that the ones after it read it instead of making it again.
    """
    t, words, grams, seen = F.coalesce(F.col(text), F.lit("")), F.col(f"{p}words"), F.col(f"{p}grams"), F.col(f"{p}seen")
    body = F.btrim(t, F.lit(WHITE))
    out = docs.withColumn(f"{p}words", F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP)))
    # A window is the hash of its words and its place; equal windows stand side by side once sorted.
    window = lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.cast("long").alias("i"))
    out = out.withColumn(f"{p}grams", F.sort_array(F.slice(F.transform(words, window), 1, F.greatest(F.size(words) - 2, F.lit(0)))))

    def same(a: Column, b: Column) -> Column:
        word = [F.get(words, a.i + k) == F.get(words, b.i + k) for k in range(3)]
        return (a.h == b.h) & word[0] & word[1] & word[2]

    twice = F.filter(grams, lambda s, k: same(s, F.get(grams, k - 1)) | same(s, F.get(grams, k + 1)))
    out = out.withColumn(f"{p}seen", F.sort_array(F.transform(twice, lambda s: s.i)))
    covered = F.aggregate(
        seen,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, i: F.struct((a.n + 3 - F.least(F.lit(3), F.greatest(F.lit(0), a.end - i))).alias("n"), (i + 3).alias("end")),
        lambda a: a.n,
    )
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_stops = F.size(F.filter(words, lambda w: w.isin(sorted(set(STOP_WORDS.split())))))
    out = out.withColumns(
        {
            f"{p}n_words": F.size(words).cast("long"),
            f"{p}word_chars": F.length(F.array_join(words, "")).cast("long"),
            f"{p}n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            f"{p}n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            f"{p}n_stops": n_stops.cast("long"),
            f"{p}lines": lines,
        }
    ).drop(f"{p}words", f"{p}grams", f"{p}seen")
    kept = F.col(f"{p}lines")
    return out.withColumns({f"{p}n_lines": F.size(kept).cast("long"), f"{p}n_dup_lines": (F.size(kept) - F.size(F.array_distinct(kept))).cast("long")}).drop(f"{p}lines")


def ratios(p: str = "q_") -> dict[str, Column]:
    """Every metric that a rule can name, as an expression over the columns of `with_metrics`."""
    c = lambda x: F.col(f"{p}{x}")
    per = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stops", "n_lines")
    return {x: c(x) for x in counts} | {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stops", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }


def failing(rules=RULES, p: str = "q_") -> Column:
    """The names of the rules a row breaks, in table order."""
    have = ratios(p)
    broken = []
    for r in rules:
        m, out = have[r.metric], F.lit(False)
        if r.low is not None:
            out = out | (m < r.low)
        if r.high is not None:
            out = out | (m > r.high)
        broken.append(F.when(out, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def base_failed(p: str = "q_") -> Column:
    return (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words"))


def judge(docs: DataFrame, text: str = "text", rules=RULES, p: str = "q_") -> DataFrame:
    """`docs` with the metrics, `{p}failed` (names of broken rules), `{p}base_failed` and `{p}kept`."""
    out = with_metrics(docs, text, p).withColumn(f"{p}failed", failing(rules, p))
    return out.withColumn(f"{p}base_failed", base_failed(p)).withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.size(f"{p}failed") == 0))


def kept(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of `docs` that pass, with its columns alone.

    A filter on an expression this large would be pushed below the projections that make its arrays, and make them
    again for each element. The verdict therefore passes through a generator, which no filter is pushed below.
    """
    p = storage.free(docs, "q_")
    judged = judge(docs, text, rules, p)
    mark = F.explode_outer(F.when(F.col(f"{p}kept"), F.array(F.lit(True)))).alias(f"{p}pass")
    return judged.select(*docs.columns, mark).where(F.col(f"{p}pass").isNotNull()).select(*docs.columns)
