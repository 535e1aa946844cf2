"""Validation, normalisation, enrichment and placement of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinelle.functions import text as X
from sentinelle.operators.mentions import with_mentions

MAY_PLACE = ("Satellite", "ExternalEvent")


def reject_reason() -> Column:
    """The first fault of an envelope (null: none); columns source, content, kind, lat, lon, precision."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    lat, lon = F.col("lat"), F.col("lon")
    return F.coalesce(
        F.when(blank("source"), "source"),
        F.when(blank("content"), "content"),
        F.when(F.length("content") > 20_000, "too long"),
        F.when(~lat.between(-90, 90), "latitude"),
        F.when(~lon.between(-180, 180), "longitude"),
        F.when(lat.isNull() != lon.isNull(), "half a pair"),
        F.when(lat.isNotNull() & ~F.col("kind").isin(*MAY_PLACE), "kind may not place"),
        F.when(F.col("precision").isNotNull() & lat.isNull(), "precision without place"),
    )


def normalised(envelopes: DataFrame) -> DataFrame:
    """Title, summary, time, type, severity and confidence; what the source declares wins over what words suggest."""
    kind = X.event_type(F.col("content"))
    stated = F.col("declared_type").isNotNull()
    return envelopes.select(
        "*",
        X.truncated(F.coalesce("declared_title", X.first_sentence(F.col("content"))), 300).alias("title"),
        X.truncated(F.trim("content"), 4000).alias("summary"),
        F.least(F.coalesce("declared_at", "received"), "received").alias("occurred"),
        F.coalesce("declared_type", kind).alias("event_type"),
        F.coalesce("declared_severity", X.marked_severity(F.col("content"))).alias("severity"),
        F.when(stated, 0.9).otherwise(X.type_confidence(kind, X.keyword_hits(F.col("content")))).alias("confidence"),
        F.when(stated, "source-declared").otherwise("keyword").alias("method"),
    )


ENRICHMENT = "schemaVersion int, language string, eventType string, severity string, confidence double, locations array<string>, entities array<struct<name:string,type:string>>"
EVENT_TYPES = ("OTHER", "CONFLICT", "MARITIME_INCIDENT", "NAVAL_INCIDENT", "PIRACY", "TERRORISM", "PROTEST", "SANCTIONS", "MILITARY_MOVEMENT", "CYBER_INCIDENT", "NATURAL_HAZARD")
SEVERITIES = ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def enrichment_errors(e: Column) -> Column:
    """Every fault of a parsed enrichment, in order."""
    word = lambda c: F.upper(F.regexp_replace(c, "[ -]", "_"))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(e.schemaVersion, F.lit(0)) != 2, "version"),
            F.when(~F.coalesce(word(e.eventType).isin(*EVENT_TYPES), F.lit(False)), "event type"),
            F.when(~F.coalesce(word(e.severity).isin(*SEVERITIES), F.lit(False)), "severity"),
            F.when(~F.coalesce(e.confidence.between(0, 1) & ~F.isnan(e.confidence), F.lit(False)), "confidence"),
            F.when(F.size(e.locations) > 5, "locations"),
            F.when(F.size(e.entities) > 12, "entities"),
        )
    )


def merged(observations: DataFrame, least: float = 0.35) -> DataFrame:
    """Enrichment over keywords, declarations over both; below `least` only extractions are taken.

    Columns: declared_type, event_type, model_type, model_confidence, place, model_place, entities, model_entities.
    """
    sure = F.coalesce(F.col("model_confidence") >= least, F.lit(False))
    both = F.concat("entities", F.coalesce("model_entities", F.array().cast("array<string>")))
    # One of each name whatever its case, in order of appearance.
    ordered = F.filter(both, lambda x, i: F.array_position(F.transform(both, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return observations.select(
        "id",
        F.when(F.col("declared_type").isNotNull(), F.col("declared_type")).when(sure, F.col("model_type")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.trim(F.coalesce("place", F.lit(""))) == "", F.col("model_place")).otherwise(F.col("place")).alias("place"),
        F.slice(ordered, 1, 12).alias("entities"),
        F.when(sure & F.col("declared_type").isNotNull(), "source-declared+ai").when(sure, "ai").otherwise("keyword").alias("method"),
    )


def translation_state(declared: Column, detected: Column, english: Column, method: Column) -> Column:
    tag = F.coalesce(declared, detected)
    return (
        F.when((F.trim(F.coalesce(english, F.lit(""))) != "") & method.isNotNull(), "MachineTranslated")
        .when(F.coalesce(tag.rlike("(?i)^en(-.*)?$"), F.lit(False)), "AlreadyEnglish")
        .otherwise("NotTranslated")
    )


def resolved(observations: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Where each observation is: declared coordinates first, then the lexicon, else a reason.

    `lexicon` has key, country, g_lat, g_lon, g_precision; a key with several entries needs the observation's country.
    The lexicon's own size decides how it is joined; nothing forces a broadcast.
    """
    single = lexicon.groupBy("key").agg(F.count("*").alias("entries"), F.min(F.struct("g_lat", "g_lon", "g_precision")).alias("only"))
    inside = lexicon.groupBy("key", F.col("country").alias("g_country")).agg(F.count("*").alias("here"), F.min(F.struct("g_lat", "g_lon", "g_precision")).alias("local"))
    o = observations.withColumn("key", X.plain_key(F.col("place")))
    j = o.join(single, "key", "left").join(inside, (o["key"] == inside["key"]) & (o["country"] == inside["g_country"]), "left").drop(inside["key"])
    found = F.when(F.col("entries") == 1, F.col("only")).when(F.col("here") == 1, F.col("local"))
    declared = F.when(F.col("lat").isNotNull(), F.struct(F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), F.coalesce("precision", F.lit("Exact")).alias("g_precision")))
    at = F.coalesce(declared, found)
    by = F.when(declared.isNotNull(), F.when(at.g_precision == "Exact", 0.95).when(at.g_precision == "Settlement", 0.85).when(at.g_precision == "Region", 0.6).otherwise(0.35)).when(
        found.isNotNull(), F.when(at.g_precision == "Settlement", 0.7).when(at.g_precision == "Region", 0.55).otherwise(0.3)
    )
    reason = F.when(at.isNotNull(), None).when(F.trim(F.coalesce("place", F.lit(""))) == "", "no place").when(F.col("entries").isNull(), "unknown").otherwise("ambiguous")
    return j.select("id", at.g_lat.alias("at_lat"), at.g_lon.alias("at_lon"), at.g_precision.alias("at_precision"), by.alias("confidence"), reason.alias("reason"))


def resolved_in_context(observations: DataFrame, lexicon: DataFrame, text: str = "text", mentions: int = 12) -> DataFrame:
    """`resolved`, and where several places share a name and the declared country does not tell them apart, the countries
    of other places that the text names do: finest first, then in order of appearance. Only texts of such observations
    are read; a country decides if it has one place of that name."""
    first = resolved(observations, lexicon)
    unsure = observations.withColumn("key", X.plain_key(F.col("place"))).join(first.where("reason = 'ambiguous'").select("id"), "id", "left_semi").select("id", "key", F.col(text).alias("text"))
    sure = lexicon.groupBy("key").agg(F.count("*").alias("entries"), F.min("country").alias("country"), F.min("g_precision").alias("p")).where("entries = 1")
    found = with_mentions(unsure, sure.select(F.col("key").alias("name"))).select("id", "key", F.posexplode("mentions").alias("at", "name")).where(F.col("at") < mentions)
    named = found.join(sure.select(F.col("key").alias("name"), "country", "p"), "name")
    rank = F.array_position(F.array(*[F.lit(p) for p in ("Settlement", "Region", "Country")]), F.col("p"))
    local = lexicon.groupBy("key", "country").agg(F.count("*").alias("here"), F.min(F.struct("g_lat", "g_lon", "g_precision")).alias("spot")).where("here = 1")
    told = named.join(local, ["key", "country"]).groupBy("id").agg(F.min_by("spot", F.struct(rank.alias("rank"), "at")).alias("spot"))
    level = F.when(F.col("spot.g_precision") == "Settlement", 0.7).when(F.col("spot.g_precision") == "Region", 0.55).otherwise(0.3)
    told = told.select("id", "spot", level.alias("level"))
    pick = lambda c, field: F.when(F.col("spot").isNotNull(), field).otherwise(F.col(c)).alias(c)
    joined = first.join(told, "id", "left")
    return joined.select("id", pick("at_lat", F.col("spot.g_lat")), pick("at_lon", F.col("spot.g_lon")), pick("at_precision", F.col("spot.g_precision")), pick("confidence", F.col("level")), pick("reason", F.lit(None).cast("string")))


def submitted(posts: DataFrame, now: int, per_minute: int = 30) -> DataFrame:
    """Manual submissions as envelopes: the kind is Manual and the source an anonymous user, whatever they declare; a
    client's submissions beyond `per_minute` in one minute are rejected. `posts` has client and at (microseconds)."""
    window = Window.partitionBy("client", F.floor(F.col("at") / 60_000_000)).orderBy("at")
    late = F.row_number().over(window) > per_minute
    forced = {"kind": F.lit("Manual"), "tier": F.lit("UserGenerated"), "platform": F.lit(None).cast("string"), "channel": F.lit(None).cast("string"), "received": F.lit(now)}
    return posts.withColumns(forced | {"reject_reason": F.when(late, "too many submissions")})
