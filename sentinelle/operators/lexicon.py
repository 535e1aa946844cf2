"""Building the place lexicon: admission of rows, one entry for a name with several bearers, entities in texts."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinelle.operators import graph
from sentinelle.session import settled

# Feature codes and the precision each stands for.
FEATURES = {"PPLC": "Settlement", "PPLA": "Settlement", "PPLA2": "Settlement", "PPL": "Settlement", "ADM1": "Region", "ADM2": "Region", "PCLI": "Country"}
#: Inhabitants a plain town needs, degrees within which two entries are one place or one holds the other, and how far a winner must lead.
TOWN, SAME, NESTED, LEAD = 5000, 0.05, 1.5, 10
#: Levels that a place may lie below another one.
DEPTH = 12


def admitted(rows: DataFrame) -> DataFrame:
    """Rows of a known feature and country, off the null island; plain towns only with enough inhabitants."""
    precision = F.element_at(F.create_map(*[x for k, v in FEATURES.items() for x in (F.lit(k), F.lit(v))]), F.col("feature"))
    out = rows.withColumn("precision", precision).where(F.col("precision").isNotNull() & F.col("country").isNotNull())
    return out.where((F.col("lat") != 0) | (F.col("lon") != 0)).where((F.col("feature") != "PPL") | (F.col("population") >= TOWN))


def ancestors(places: DataFrame) -> DataFrame:
    """(id, ancestor, steps) of every place that lies in another one, at any depth; `places` has id and parent.

    Each round joins what the last one found with the parents, and is settled, so that no round runs again in the next;
    a place that is its own ancestor by mistake stops at DEPTH. (A recursive query of Spark's stops at a million rows.)
    """
    parents = settled(places.select("id", "parent").where("parent is not null"))
    above = parents.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    last = out = parents.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    for step in range(2, DEPTH + 1):
        last = settled(last.join(above, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(step).alias("steps")))
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out.groupBy("id", "ancestor").agg(F.min("steps").alias("steps"))


def deepest(entries: DataFrame, within: DataFrame) -> DataFrame:
    """Entries (key, id, country) without those that, for one key and country, hold another one of the key: the deeper
    place is meant. `within` has id and ancestor."""
    inner = entries.select("key", "country", F.col("id").alias("_in")).join(within.select(F.col("id").alias("_in"), F.col("ancestor").alias("id")), "_in")
    return entries.join(inner.select("key", "country", "id").distinct(), ["key", "country", "id"], "left_anti")


def disambiguated(entries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """key, chosen (null: undecided), places: what a bare name means. `entries` has key, id (its own), lat, lon, population.

    Entries of a name that lie together, or one inside the other, are one place; what lies inside what is told by
    administrative codes (`within`: id, ancestor) where they are given, and by distance elsewhere; the most populous place wins if it has
    TOWN inhabitants and LEAD times those of the next. Neighbours meet by grid cell; of a name's places only the two
    most populous are kept, so a name may have any number of bearers.
    """
    rows = entries.select("key", "id", "lat", "lon", "population")
    y, x = F.floor(F.col("lat") / NESTED), F.floor(F.col("lon") / NESTED)
    near = lambda c: F.explode(F.array(*[c + k for k in (-1, 0, 1)]))
    a = rows.select("key", *[F.col(c).alias(f"{c}_a") for c in ("id", "lat", "lon", "population")], y.alias("y"), x.alias("x"))
    b = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "lat", "lon", "population")], near(y).alias("y"), x.alias("x")).withColumn("x", near(F.col("x")))
    apart = F.greatest(F.abs(F.col("lat_a") - F.col("lat_b")), F.abs(F.col("lon_a") - F.col("lon_b")))
    one = (apart <= SAME) | ((apart <= NESTED) & (F.least("population_a", "population_b") == 0))
    edges = a.join(b, ["key", "y", "x"]).where((F.col("id_a") < F.col("id_b")) & one).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    if within is not None:
        inside = rows.select("key", F.col("id").alias("a")).join(within.select(F.col("id").alias("a"), F.col("ancestor").alias("b")), "a")
        edges = edges.union(inside.join(rows.select("key", F.col("id").alias("b")), ["key", "b"]).select("a", "b"))
    same = graph.connected(edges)
    places = rows.join(same, "id", "left").groupBy("key", F.coalesce("component", "id").alias("place")).agg(F.max(F.struct("population", (-F.col("id")).alias("back"))).alias("best"))
    ahead = Window.partitionBy("key").orderBy(F.desc("best"))
    top = places.withColumn("r", F.row_number().over(ahead)).where("r <= 2").groupBy("key").agg(F.max("best").alias("top"), F.min(F.when(F.col("r") == 2, F.col("best.population"))).alias("next"))
    sure = F.col("next").isNull() | ((F.col("top.population") >= TOWN) & (F.col("top.population") >= LEAD * F.col("next")))
    return top.join(places.groupBy("key").agg(F.count("*").alias("places")), "key").select("key", F.when(sure, -F.col("top.back")).alias("chosen"), "places")


def outside(places: DataFrame, extents: DataFrame, slack: float = 0.1) -> DataFrame:
    """Places beyond their country's extent (south, north, west, east) by more than `slack` degrees, or of no known country."""
    j = places.join(extents, "country", "left")
    within = F.col("g_lat").between(F.col("south") - slack, F.col("north") + slack) & F.col("g_lon").between(F.col("west") - slack, F.col("east") + slack)
    return j.where(~F.coalesce(within, F.lit(False))).select(*places.columns)


def faults(places: DataFrame, extents: DataFrame, anchors: DataFrame, separators: tuple[str, ...] = ("\t", "|")) -> DataFrame:
    """(fault, key, country) of what a lexicon must not have: places outside their country, names that hold a separator of
    the file they are written to, and anchors (key, country) that it lacks."""
    told = lambda df, fault: df.select(F.lit(fault).alias("fault"), "key", "country")
    split = F.lit(False)
    for s in separators:
        split = split | F.contains("key", F.lit(s))
    missing = anchors.select("key", "country").distinct().join(places.select("key", "country").distinct(), ["key", "country"], "left_anti")
    return told(outside(places, extents), "outside").union(told(places.where(split), "separator")).union(told(missing, "missing"))


def outermost(runs: list[str]) -> list[str]:
    """Distinct `runs` without those inside another one, which they begin in at a letter that is not small. No two runs are
    held against each other: what is looked for in a run has the length of a shorter one."""
    known, lengths, inner = set(runs), sorted({len(r) for r in runs}), set()
    for run in runs:
        shorter = lengths[: bisect.bisect_left(lengths, len(run))]
        for at, letter in enumerate(run if shorter else ""):
            if letter.islower() or letter in " '-":
                continue
            for n in shorter[: bisect.bisect_right(shorter, len(run) - at)]:
                if (part := run[at : at + n]) in known:
                    inner.add(part)
    return [r for r in runs if r not in inner]


def capitalised(text) -> Column:
    """All runs of capitalised words, in order, without those inside longer ones."""

    @F.pandas_udf("array<string>")
    def kept(found: pd.Series) -> pd.Series:
        return found.map(lambda runs: None if runs is None else outermost(list(runs)))

    # The last quantifier gives nothing back: nothing follows it, and a run of any length takes no stack.
    return kept(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*+"), F.lit(0))))


def choice_fault(body: Column, offered: Column, least: float = 0.35) -> Column:
    """Why a model's choice among the offered conflicts does not count (null: it does)."""
    c = F.from_json(body, "key string, confidence double")
    return (
        F.when(c.isNull() | c.key.isNull(), "unreadable")
        .when((c.key != "NONE") & ~F.array_contains(offered, c.key), "not offered")
        .when(~F.coalesce(c.confidence.between(0, 1), F.lit(False)), "confidence")
        .when(c.confidence < least, "unsure")
    )
