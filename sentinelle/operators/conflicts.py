"""Conflict membership, activity, tempo, registers and control of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinelle.functions import scores


def tally(reports: DataFrame, *by) -> DataFrame:
    """Reports, sources (whatever their case) and incidents of each conflict; a report counts for all of its conflicts."""
    return reports.select("*", F.explode("conflicts").alias("conflict")).groupBy("conflict", *by).agg(
        F.count("*").alias("reports"), F.count_distinct(F.lower("source")).alias("sources"), F.count_distinct("incident").alias("incidents")
    )


def tempo(reports: DataFrame, at: str, now: int, width: int) -> DataFrame:
    """This window against the one before, in one pass over both."""
    both = reports.where((F.col(at) >= now - 2 * width) & (F.col(at) < now)).select("*", F.explode("conflicts").alias("conflict"))
    now_ = F.col(at) >= now - width
    source = F.lower("source")
    sums = both.groupBy("conflict").agg(
        F.count_if(now_).alias("reports"), F.count_if(~now_).alias("before"), F.count_distinct(F.when(now_, source)).alias("sources"), F.count_distinct(F.when(~now_, source)).alias("sources_before")
    )
    return sums.withColumn("verdict", scores.tempo(F.col("reports"), F.col("before"), F.col("sources"), F.col("sources_before")))


def memberships(reports: DataFrame, register: DataFrame) -> DataFrame:
    """The strongest reason each report has for each conflict: coded 4, actor 3, place 2, country 1.

    Four joins by equality on exploded keys stand in for comparing every report with every conflict. `register` has
    key, code, tokens, places and country.
    """
    by_code = reports.join(register.select("key", F.col("code").alias("k")), F.col("code") == F.col("k")).select("id", "key", F.lit(4).alias("basis"), F.lit(0).alias("shared"))
    words = reports.select("id", F.explode("tokens").alias("token")).join(register.select("key", F.explode("tokens").alias("token")), "token")
    by_actor = words.groupBy("id", "key").agg(F.count("*").cast("int").alias("shared")).select("id", "key", F.lit(3).alias("basis"), "shared")
    by_place = reports.select("id", "place", "country").join(register.select("key", "country", F.explode("places").alias("place")), ["country", "place"]).select("id", "key", F.lit(2).alias("basis"), F.lit(0).alias("shared"))
    by_country = reports.select("id", "country").join(register.select("key", "country"), "country").select("id", "key", F.lit(1).alias("basis"), F.lit(0).alias("shared"))
    every = by_code.union(by_actor).union(by_place).union(by_country)
    return every.groupBy("id", "key").agg(F.max("basis").alias("basis"), F.max("shared").alias("shared"))


def assigned(members: DataFrame, register: DataFrame, few: int = 2, most: int = 8) -> DataFrame:
    """id, basis (the strongest), conflicts (what the report goes to) and candidates (what it could be), as lists of keys.

    A code decides for all its conflicts. Named actors decide by the words shared: for those with the most, unless several
    share fewer than `few`, or more than `most` share as many. A place or country decides if it names exactly one
    conflict. Lists have `most` keys, strongest first, then by `events`, the coded events of the register. A report has
    at most one row for each conflict of the register.
    """
    rows = members.join(register.select("key", F.coalesce("events", F.lit(0)).alias("events")), "key")
    entry = F.struct((-F.col("basis")).alias("b"), (-F.col("events")).alias("e"), "key", "shared")
    out = rows.groupBy("id").agg(F.max("basis").alias("basis"), F.array_sort(F.collect_list(entry)).alias("all"))
    best = F.filter("all", lambda m: m.b == -F.col("basis"))
    top = F.array_max(F.transform(best, lambda m: m.shared))
    named = F.filter(best, lambda m: m.shared == top)
    few_words, too_many = (F.size(named) > 1) & (top < few), F.size(named) > most
    none = F.slice(best, 1, 0)
    goes = F.when(F.col("basis") == 4, best).when(F.col("basis") == 3, F.when(few_words | too_many, none).otherwise(named)).otherwise(F.when(F.size(best) == 1, best).otherwise(none))
    could = F.when((F.col("basis") == 3) & ~few_words & too_many, named).otherwise(F.array_except(F.col("all"), goes))
    keys = lambda c: F.transform(F.slice(c, 1, most), lambda m: m.key)
    return out.select("id", "basis", keys(goes).alias("conflicts"), keys(could).alias("candidates"))


def pruned_tokens(register: DataFrame, share: float = 0.1, least: int = 40) -> DataFrame:
    """Actor tokens without those in more than `share` of the conflicts (registers under `least` stay whole)."""
    tokens = register.select("key", F.explode(F.array_distinct("tokens")).alias("token"))
    n = register.agg(F.count("*").alias("n"))
    common = tokens.groupBy("token").agg(F.count("*").alias("uses")).crossJoin(F.broadcast(n)).where((F.col("n") >= least) & (F.col("uses") > share * F.col("n"))).select("token")
    return tokens.join(common, "token", "left_anti")


def control(claims: DataFrame, now: int, day: int, contested: int = 14, stale: int = 30, window: int = 90) -> DataFrame:
    """Who holds each place: Insufficient, Assessed, Contested or Stale. `claims` has place, at, signal, coded, actor, source."""
    live = claims.where((F.col("at") >= now - window * day) & (F.col("at") < now)).withColumn("place", F.lower("place"))
    gain = F.col("signal") != "WithdrawalReported"
    # Two aggregations keyed by place; a busy place is pre-aggregated in each task.
    newest = live.where(gain).groupBy("place").agg(F.max("at").alias("newest"))
    rows = live.where(gain).join(newest, "place").groupBy("place").agg(
        F.max("newest").alias("newest"),
        F.count("*").alias("claims"),
        F.max("coded").alias("coded"),
        F.count_distinct(F.lower("source")).alias("sources"),
        F.count_distinct(F.when(F.col("at") >= F.col("newest") - contested * day, F.lower("actor"))).alias("actors"),
        F.max_by("actor", F.struct("at", "actor")).alias("holder"),
    )
    verdict = (
        F.when(F.coalesce("claims", F.lit(0)) == 0, "Insufficient")
        .when(~F.col("coded") & (F.col("sources") < 2), "Insufficient")
        .when(F.col("actors") > 1, "Contested")
        .when(F.col("newest") < now - stale * day, "Stale")
        .otherwise("Assessed")
    )
    places = live.select("place").distinct()
    return places.join(rows, "place", "left").withColumn("verdict", verdict).select("place", "verdict", F.when(F.col("verdict") == "Assessed", F.col("holder")).alias("holder"), F.coalesce("claims", F.lit(0).cast("long")).alias("claims"))


def actor_tokens(name):
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), lambda w: F.length(w) >= 3))

