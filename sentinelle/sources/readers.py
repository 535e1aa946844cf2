"""Readers of provider files: each turns raw rows into observations with the engine's columns, or a reason to reject.

Schemas are declared, never inferred; numbers arrive as text and are cast with a null on failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinelle.functions import text as X

ITEM = "struct<kind:string,url:string,publisher:string,platform:string,channel:string,title:string,publishedAt:timestamp,postedAt:timestamp,retrievedAt:timestamp,contentHash:string,language:string,excerpt:string,excerptTranslation:string,placeNames:array<string>,relatedTo:array<string>>"
BUNDLE = f"schemaVersion int, bundleId string, collectedAt timestamp, brief struct<id:string,revision:int,windowFrom:timestamp,windowTo:timestamp>, collector struct<role:string,runId:string>, items array<{ITEM}>, coverage struct<sources:array<struct<channel:string,outcome:string,reason:string,read:int,matched:int,collected:int>>>"
BUNDLE_KEYS = ("schemaVersion", "bundleId", "collectedAt", "brief", "collector", "items", "coverage")
PLATFORMS = ("telegram", "bluesky", "mastodon", "x")


def bundles(spark: SparkSession, path: str, now, max_age_days: int = 14) -> DataFrame:
    """Accepted bundles, one row a file; malformed files, unknown versions and unknown keys drop the file."""
    return accepted(spark.read.text(path, wholetext=True), now, max_age_days)


def accepted(files: DataFrame, now, max_age_days: int = 14) -> DataFrame:
    """The bundles of whole files, read at once or as they land."""
    raw = files.select(F.col("_metadata.file_name").alias("file"), "value")
    known = F.array(*[F.lit(k) for k in BUNDLE_KEYS])
    parsed = raw.withColumn("keys", F.json_object_keys("value")).withColumn("b", F.from_json("value", BUNDLE, {"mode": "PERMISSIVE"}))
    good = F.col("keys").isNotNull() & (F.size(F.array_except("keys", known)) == 0) & (F.col("b.schemaVersion") == 1) & F.col("b.items").isNotNull() & (F.size("b.items") > 0)
    return parsed.where(good).where(F.col("b.collectedAt") >= now - F.expr(f"interval {max_age_days} days")).select("file", "b.*")


def item_reason(i: Column, now: Column, excerpt: int = 1000, places: int = 8) -> Column:
    """The first fault of a bundle item (null: none)."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    shown = F.coalesce(i.publishedAt, i.postedAt)
    user = i.kind == "userGenerated"
    return F.coalesce(
        F.when(~F.coalesce(i.kind.isin("document", "userGenerated"), F.lit(False)), "kind"),
        F.when(~F.coalesce(i.url.rlike(r"^https?://[^/\s]+"), F.lit(False)), "url"),
        F.when(~user & empty(i.publisher), "publisher"),
        F.when(user & (empty(i.platform) | empty(i.channel)), "channel"),
        F.when(user & ~F.lower(i.platform).isin(*PLATFORMS), "platform"),
        F.when(shown.isNull(), "published"),
        F.when(shown > now, "published in the future"),
        F.when(i.retrievedAt > now, "retrieved in the future"),
        F.when(i.retrievedAt < shown, "retrieved before published"),
        F.when(~F.coalesce(X.sha256_ok(i.contentHash), F.lit(False)), "hash"),
        F.when(i.excerptTranslation.isNotNull(), "translation"),
        F.when(empty(i.excerpt), "excerpt"),
        F.when((F.length(i.excerpt) > excerpt) & (X.elements(i.excerpt) > excerpt), "excerpt too long"),
        F.when(F.size(i.placeNames) > places, "places"),
    )


def bundle_items(accepted: DataFrame, now: Column) -> DataFrame:
    """One row for each item with its reason; a URL counts once in a bundle, at its first place."""
    rows = accepted.select("file", F.posexplode("items").alias("pos", "i")).withColumn("reason", item_reason(F.col("i"), now))
    first = F.row_number().over(Window.partitionBy("file", "i.url", F.col("reason").isNull()).orderBy("pos"))
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "url repeated").otherwise(F.col("reason")))


def firms(spark: SparkSession, path: str) -> DataFrame:
    """Satellite hotspots from CSV addressed by header; rows without place, date or time go."""
    raw = spark.read.csv(path, header=True)
    bright = F.col("bright_ti4") if "bright_ti4" in raw.columns else F.col("brightness")
    said = F.lower(F.trim("confidence"))
    named = F.when(said.startswith("h"), 90).when(said.startswith("n"), 60).when(said.startswith("l"), 20)
    clock = F.col("acq_time").try_cast("int")
    at = F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.format_string("%02d:%02d", F.floor(clock / 100), clock % 100)), F.lit("yyyy-MM-dd HH:mm"))
    out = raw.select(
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"),
        bright.try_cast("double").alias("brightness"),
        at.alias("at"),
        "satellite",
        F.coalesce(named, F.greatest(F.lit(0), F.least(F.lit(100), said.try_cast("int")))).alias("confidence"),
        F.col("frp").try_cast("double").alias("power"),
        (F.upper(F.trim("daynight")) == "N").alias("night"),
    )
    return out.where("lat between -90 and 90 and lon between -180 and 180 and at is not null")


def feed_items(spark: SparkSession, path: str, row_tag: str = "item|entry") -> DataFrame:
    """Items of RSS and RDF feeds and entries of Atom ones, in one pass and whatever prefix their names carry; files with
    a DOCTYPE are left out as a whole. Titles have 400 characters at most, summaries 4,000."""
    fields = "title string, description string, summary string, content string, encoded string, guid string, id string, link string, pubDate string, date string, updated string, published string, language string"
    raw = spark.read.text(path, wholetext=True).where(~F.col("value").rlike("(?i)<!doctype"))
    # Prefixes go from names of elements; Atom's links carry their address in an attribute, RDF's items their name.
    plain = F.regexp_replace("value", r"<(/?)[A-Za-z][\w.-]*:([\w.-]+)", "<$1$2")
    plain = F.regexp_replace(plain, r"<link\b[^>]*\bhref=\"([^\"]*)\"[^>]*/>", "<link>$1</link>")
    plain = F.regexp_replace(plain, r"<item\b[^>]*\babout=\"([^\"]*)\"[^>]*>", "<item><id>$1</id>")
    one = F.explode(F.regexp_extract_all(plain, F.lit(rf"(?s)<((?:{row_tag}))[\s>].*?</\1>"), F.lit(0))).alias("xml")
    x = raw.select(one).select(F.from_xml(F.regexp_replace("xml", r"\s(?:xmlns|[\w.-]+:[\w.-]+)=\"[^\"]*\"", ""), fields).alias("x")).select("x.*")
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")
    said = F.regexp_replace(F.coalesce("pubDate", "published", "updated", "date"), r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(*[F.try_to_timestamp(said, F.lit(f)) for f in formats])
    clean = lambda c, n: X.truncated(X.stripped_html(c), n)
    language = F.when(X.language_tag_ok(F.trim("language")), F.lower(F.trim("language")))
    body = F.coalesce("description", "summary", "content", "encoded")
    return x.select(F.coalesce("guid", "id", "link").alias("identifier"), F.col("link").alias("url"), clean(F.col("title"), 400).alias("title"), clean(body, 4000).alias("summary"), at.alias("published"), language.alias("language"))


# What every provider's rows are, as (kind, tier, provenance, event type, severity); null: the rows say.
PROVIDERS = {
    "ACLED": ("ExternalEvent", "Published", "Polled", None, None),
    "UCDP": ("ExternalEvent", "Published", "Polled", None, None),
    "FIRMS": ("Satellite", "Published", "Polled", "NaturalHazard", "Low"),
    "RSS": ("News", "Published", "Polled", None, None),
    "document": ("News", "Published", "Collected", None, None),
    "userGenerated": ("Manual", "UserGenerated", "Collected", None, None),
}


def envelopes(df: DataFrame, source: str, provider: str) -> DataFrame:
    """Provider rows as observations; sources are then united by `unionByName(allowMissingColumns=True)`. Only satellites
    and event providers may say where something is: coordinates of all others are dropped."""
    kind, tier, provenance, event_type, severity = PROVIDERS[provider]
    out = df.withColumns({"source": F.lit(source), "kind": F.lit(kind), "tier": F.lit(tier), "provenance": F.lit(provenance)})
    out = out.withColumns({c: F.lit(v) for c, v in (("event_type", event_type), ("severity", severity)) if v})
    if kind not in ("Satellite", "ExternalEvent"):
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon") if c in out.columns})
    return out
