"""Windowed counts, gap-filled series, activity scores and top-k reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinelle.functions import scores
from sentinelle.sources.views import HOUR


def within(df: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """Half-open window [start, end) in microseconds."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def counts_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def activity(incidents: DataFrame, now: int, windows=scores.WINDOWS) -> DataFrame:
    """One row for each reporting window. Incidents are read once: each falls into every window that covers it."""
    spark = incidents.sparkSession
    spine = spark.createDataFrame([(t, h, now - h * HOUR) for t, h, _ in windows], "token string, hours int, since long")
    longest = max(h for _, h, _ in windows)
    # Four constant rows: a broadcast of known size, whatever the incidents.
    per = within(incidents, "occurred", now - longest * HOUR, now).crossJoin(F.broadcast(spine)).where(F.col("occurred") >= F.col("since"))
    part = scores.contribution(F.col("severity"), (now - F.col("occurred")) / HOUR, F.col("evidence"), F.col("confidence"), F.col("hours"))
    sums = per.groupBy("token").agg(F.sum(part).alias("weight"), F.count("*").alias("incidents"))
    rate = F.coalesce(F.col("weight"), F.lit(0.0)) / (F.col("hours") / 24)
    value = scores.score(rate)
    return F.broadcast(spine).join(sums, "token", "left").select(
        "token", F.coalesce("incidents", F.lit(0).cast("long")).alias("incidents"), F.round(rate, 4).alias("rate_per_day"), F.round(value, 4).alias("score"), scores.band(value).alias("band")
    )


def activity_bins(incidents: DataFrame, windows=scores.WINDOWS) -> DataFrame:
    """(bin, token, weight, incidents): what the incidents of an hour weigh at its end, for every reporting window.

    Weights halve in a window's own time, so those of a bin at any later time are a multiple of it: bins are stored
    once, added up for late incidents, and read instead of incidents.
    """
    spine = incidents.sparkSession.createDataFrame([(t, h) for t, h, _ in windows], "token string, hours int")
    each = incidents.withColumn("bin", F.floor(F.col("occurred") / HOUR)).crossJoin(F.broadcast(spine))
    part = scores.contribution(F.col("severity"), ((F.col("bin") + 1) * HOUR - F.col("occurred")) / HOUR, F.col("evidence"), F.col("confidence"), F.col("hours"))
    return each.groupBy("bin", "token").agg(F.sum(part).alias("weight"), F.count("*").alias("incidents"))


def activity_from_bins(bins: DataFrame, incidents: DataFrame, now: int, windows=scores.WINDOWS) -> DataFrame:
    """`activity` from stored bins; of `incidents` only those of hours that a window's ends cut are read."""
    spine = bins.sparkSession.createDataFrame([(t, h, now - h * HOUR) for t, h, _ in windows], "token string, hours int, since long")
    last = now // HOUR
    whole = bins.join(F.broadcast(spine), "token").where((F.col("bin") * HOUR >= F.col("since")) & (F.col("bin") < last))
    aged = F.col("weight") * F.pow(F.lit(0.5), (now / HOUR - (F.col("bin") + 1)) / (F.col("hours") / 4.0))
    parts = whole.select("token", aged.alias("weight"), "incidents")
    if now % HOUR:
        cut = [last * HOUR, *((now - h * HOUR) // HOUR * HOUR for _, h, _ in windows)]
        edge = functools.reduce(lambda a, b: a | b, [(F.col("occurred") >= c) & (F.col("occurred") < c + HOUR) for c in cut])
        own = F.floor(F.col("occurred") / HOUR)
        # An hour is read by itself where the window begins inside it or now is.
        rows = within(incidents, "occurred", min(cut), now).where(edge).crossJoin(F.broadcast(spine)).where((F.col("occurred") >= F.col("since")) & ((own == last) | (own * HOUR < F.col("since"))))
        part = scores.contribution(F.col("severity"), (now - F.col("occurred")) / HOUR, F.col("evidence"), F.col("confidence"), F.col("hours"))
        parts = parts.unionByName(rows.select("token", part.alias("weight"), F.lit(1).cast("long").alias("incidents")))
    sums = parts.groupBy("token").agg(F.sum("weight").alias("weight"), F.sum("incidents").alias("incidents"))
    rate = F.coalesce(F.col("weight"), F.lit(0.0)) / (F.col("hours") / 24)
    value = scores.score(rate)
    return F.broadcast(spine).join(sums, "token", "left").select(
        "token", F.coalesce("incidents", F.lit(0).cast("long")).alias("incidents"), F.round(rate, 4).alias("rate_per_day"), F.round(value, 4).alias("score"), scores.band(value).alias("band")
    )


def series(df: DataFrame, column: str, now: int, hours: int, bucket_hours: int) -> DataFrame:
    """Counts by bucket, anchored at the start of the window; empty buckets are there with zeros."""
    n = hours // bucket_hours
    start = now - hours * HOUR
    width = bucket_hours * HOUR
    index = F.least(F.lit(n - 1), F.floor((F.col(column) - start) / width)).cast("int")
    counted = within(df, column, start, now).groupBy(index.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= 3).alias("elevated"))
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    zero = F.lit(0).cast("long")
    return spine.join(counted, "bucket", "left").select("bucket", (start + F.col("bucket") * width).cast("long").alias("starts"), F.coalesce("n", zero).alias("n"), F.coalesce("elevated", zero).alias("elevated"))


def newest(df: DataFrame, column: str, take: int, at_most: int, *ties: str) -> DataFrame:
    """The newest rows; `take` is held between 1 and `at_most`."""
    return df.orderBy(F.desc(column), *ties).limit(max(1, min(at_most, take)))


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each row with the id of the first row that has its key (null for the first itself).

    The first row of a key comes from an aggregation with partial results, so a frequent key does not gather in a task.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    joined = df.join(first, key)
    return joined.withColumn("duplicate_of", F.when(F.struct(*order) != F.col("_first"), F.col("_first")[order[-1]])).drop("_first")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def share_of_largest(df: DataFrame, value: str) -> DataFrame:
    """Adds `share`, the value over the largest; the largest is one aggregated row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.max(value).alias("_most")))).withColumn("share", F.col(value) / F.col("_most")).drop("_most")


def capped(items: DataFrame, order: list, per_channel: int = 3, per_platform: int = 8, total: int = 40) -> DataFrame:
    """Layered caps: an item counts against the next cap only if the one before kept it."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = items.withColumn("_r", rank("platform", "channel")).where(F.col("_r") <= per_channel)
    kept = kept.withColumn("_r", rank("platform")).where(F.col("_r") <= per_platform)
    return kept.drop("_r").orderBy(*order).limit(total)


def overfull(df: DataFrame, cap: int) -> DataFrame:
    """Whether more rows match than a report shows, found by reading one more than it shows."""
    return df.limit(cap + 1).agg(F.count("*").alias("probe")).select(F.least(F.col("probe"), F.lit(cap).cast("long")).alias("shown"), (F.col("probe") > cap).alias("truncated"))


def gaps(df: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """keys, starts, ends of stretches of more than `width` between neighbours in time.

    Two rows of a time bin of that width are never so far apart, so only each bin's first and last time are put in order.
    """
    bins = df.groupBy(*keys, F.floor(F.col(at) / width).alias("_bin")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    return bins.select(*keys, F.lag("_last").over(w).alias("starts"), F.col("_first").alias("ends")).where(F.col("ends") - F.col("starts") > width)


def nearest_ranks(df: DataFrame, key: str, value: str, shares: dict[str, float], width: float = 1.0) -> DataFrame:
    """For each key the values at the nearest rank of `shares` (name -> share), exactly.

    Values are counted by ranges of `width` first; the range that holds a rank is found among the counts, and only its
    own values, counted once each, are put in order.
    """
    seen = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n")).withColumn("_range", F.floor(F.col(value) / width))
    ranges = seen.groupBy(key, "_range").agg(F.sum("_n").alias("_in"))
    total = seen.groupBy(key).agg(F.sum("_n").alias("_all"))
    upto = F.sum("_in").over(Window.partitionBy(key).orderBy("_range"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("_all") * s)).alias("rank")) for n, s in shares.items()]))
    spots = ranges.withColumn("_before", upto - F.col("_in")).join(total, key).withColumn("_want", wanted)
    spots = spots.where((F.col("_want.rank") > F.col("_before")) & (F.col("_want.rank") <= F.col("_before") + F.col("_in")))
    inside = seen.join(spots, [key, "_range"]).withColumn("_reach", F.col("_before") + F.sum("_n").over(Window.partitionBy(key, "_range", "_want.name").orderBy(value)))
    hit = lambda n: F.min(F.when((F.col("_want.name") == n) & (F.col("_reach") >= F.col("_want.rank")), F.col(value))).alias(n)
    return inside.groupBy(key).agg(*[hit(n) for n in shares])
