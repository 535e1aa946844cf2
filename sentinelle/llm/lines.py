"""Line dedup by distinct-site spread.

Each line is known by a 128-bit hash; its spread is the number of distinct sites that have it. HyperLogLog sketches
of sites are merged by one aggregation keyed by line, with partial sketches made where the lines are read. Lines
whose estimate is clearly above the threshold are boilerplate, those clearly below are not, and those near it get an
exact distinct count. Boilerplate lines leave every document but the one where they stand first (least document id,
then place), so that no text is lost to the collection.

Boilerplate meets the lines by `skew.met`: the most frequent, bounded in number, are broadcast, and the others are
dealt out by line. From there only places go on to the documents.

Defined cases: lines are what stands between line feeds; blank lines are never boilerplate; a null site is a site of
its own; a null text has no lines and stays null; repeats of a boilerplate line inside its first document go too;
rows that share an id and a text are treated alike. A line that stands first in several documents of one id stays in the
one whose text has the least hash. Very long texts and lines are cut and hashed whole. Empty tables stay empty. Extra
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinelle.llm import skew, storage

#: Sites that make a line boilerplate; estimates within +-NEAR of it (a share) are counted exactly.
SPREAD, NEAR = 5, 0.5
#: Registers of a sketch: 2 ** PRECISION.
PRECISION = 10
LINE = ["line", "mark"]


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def exploded(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """doc, copy (a hash of the text, so that rows sharing an id stay apart), site, place and both halves of the hash
    (line, mark) of every line with a word."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc"),
        F.xxhash64(text).alias("copy"),
        F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "said"),
    )
    return rows.where(has_word(F.col("said"))).select("doc", "copy", "site", "place", F.xxhash64("said").alias("line"), F.xxhash64(F.lit(1), "said").alias("mark"))


def boilerplate(lines: DataFrame, spread: int = SPREAD, near: float = NEAR) -> DataFrame:
    """line, mark, first (where it stays) and times of every line on `spread` sites or more."""
    # One row a line, site and task reaches the shuffle at most, whatever a frequent line's count.
    sketched = lines.groupBy(*LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", PRECISION)).alias("sites"), F.min(F.struct("doc", "copy", "place")).alias("first"), F.count("*").alias("times")
    )
    sketched = storage.written(sketched.where((F.col("times") >= spread) & (F.col("sites") >= spread * (1 - near))), "spread")
    sure = sketched.where(F.col("sites") > spread * (1 + near)).drop("sites")
    close = sketched.where(F.col("sites") <= spread * (1 + near)).drop("sites")
    exact = skew.met(lines.select("site", *LINE), close.select(*LINE, "times"), LINE, "times").groupBy(*LINE).agg(F.count_distinct("site").alias("n")).where(F.col("n") >= spread)
    return sure.unionByName(close.join(exact.select(*LINE), LINE))


def places(lines: DataFrame, plates: DataFrame) -> DataFrame:
    """doc, copy and the places of the lines to cut."""
    hits = skew.met(lines.select("doc", "copy", "place", *LINE), plates, LINE, "times")
    return hits.where(~F.struct("doc", "copy", "place").eqNullSafe(F.col("first"))).groupBy("doc", "copy").agg(F.collect_set("place").alias("places"))


def without_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", spread: int = SPREAD, near: float = NEAR, prefix: str = "line_") -> DataFrame:
    """`docs` with boilerplate lines out of `text`, and `{prefix}n` (lines with a word) and `{prefix}removed` beside it."""
    p = storage.free(docs, "_line_")
    doc, copy, drop = (F.col(f"{p}{x}") for x in ("doc", "copy", "places"))
    lines = exploded(docs, doc_id, text, site)
    cut = places(lines, storage.written(boilerplate(lines, spread, near), "boilerplate"))
    cut = cut.select(F.col("doc").alias(f"{p}doc"), F.col("copy").alias(f"{p}copy"), F.col("places").alias(f"{p}places"))
    # Places are far smaller than texts, so they are hashed and the texts need no sort.
    rows = docs.join(cut.hint("shuffle_hash"), F.col(doc_id).cast("long").eqNullSafe(doc) & (F.xxhash64(text) == copy), "left")
    said = F.split(F.col(text), "\n", -1)
    # The places that stay, by one hash set, then their lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(said) - 1), drop)
    kept = F.array_join(F.transform(stay, lambda i: F.get(said, i)), "\n")
    return rows.withColumns(
        {
            f"{prefix}n": F.coalesce(F.size(F.filter(said, has_word)), F.lit(0)).cast("long"),
            f"{prefix}removed": F.coalesce(F.size(drop), F.lit(0)).cast("long"),
            text: F.when(drop.isNotNull(), kept).otherwise(F.col(text)),
        }
    ).drop(f"{p}doc", f"{p}copy", f"{p}places")
