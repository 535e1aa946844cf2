"""The read side as functions: one for each question the engine answers over its incidents and observations.

Arguments are held in their ranges; an unknown window is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinelle.functions import scores
from sentinelle.operators import analytics as A
from sentinelle.operators import conflicts as C
from sentinelle.operators import metrics as M
from sentinelle.operators import spatial as S
from sentinelle.sources.views import HOUR


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def window(token: str) -> tuple[int, int]:
    """Hours and bucket hours of a reporting window."""
    for name, hours, bucket in scores.WINDOWS:
        if name == token.lower():
            return hours, bucket
    raise ValueError(f"no such window: {token}")


def incidents(df: DataFrame, since: int | None = None, until: int | None = None, take: int = 100) -> DataFrame:
    if since is not None:
        df = df.where(F.col("occurred") >= since)
    if until is not None:
        df = df.where(F.col("occurred") <= until)
    return A.newest(df, "occurred", take, 250, "id")


def incident(df: DataFrame, number: int) -> DataFrame:
    return df.where(F.col("id") == number)


def incidents_near(df: DataFrame, lat: float, lon: float, km: float = 250, take: int = 50) -> DataFrame:
    return S.near_centre(df, lat, lon, float(clamp(km, 1, 5000))).orderBy("km", "id").limit(take)


def chokepoints(df: DataFrame, areas: DataFrame, now: int, hours: int = 720, most_km: float = 200.0) -> DataFrame:
    return S.watch_areas(A.within(df, "occurred", now - int(clamp(hours, 1, 2160)) * HOUR, now), areas, most_km)


def observations(df: DataFrame, take: int = 100) -> DataFrame:
    return A.newest(df, "received", take, 400, "id")


def observations_of(df: DataFrame, incident_key: str) -> DataFrame:
    return df.where(F.col("incident") == incident_key).orderBy(F.desc("received"), "id")


def analytics(df: DataFrame, token: str, now: int) -> dict[str, DataFrame]:
    hours, bucket = window(token)
    inside = A.within(df, "occurred", now - hours * HOUR, now)
    only = tuple(w for w in scores.WINDOWS if w[0] == token.lower())
    return {"score": A.activity(df, now, only), "series": A.series(df, "occurred", now, hours, bucket), "severity": A.counts_by(inside, "severity"), "event_type": A.counts_by(inside, "event_type")}


def windows(spark) -> DataFrame:
    return spark.createDataFrame(list(scores.WINDOWS), "token string, hours int, bucket_hours int")


def conflict_activity(reports: DataFrame, token: str, now: int) -> DataFrame:
    return C.tempo(reports, "received", now, window(token)[0] * HOUR)


def control(claims: DataFrame, now: int) -> DataFrame:
    return C.control(claims, now, 24 * HOUR)


def incident_view(df: DataFrame) -> DataFrame:
    """Incidents as they are shown: the place as one field, null without coordinates and name."""
    place = F.struct(F.col("place").alias("name"), "country", "lat", "lon")
    known = F.col("lat").isNotNull() | F.col("place").isNotNull()
    return df.select("id", "event_type", scores.severity_name(F.col("severity")).alias("severity"), "confidence", "occurred", F.when(known, place).alias("location"), F.col("evidence").alias("observation_count"), (F.col("evidence") > 1).alias("correlated"))


def observation_view(df: DataFrame, content: str = "content", excerpt: int = 4000, opinion: str | None = None) -> DataFrame:
    """Observations as they are shown: an excerpt of the content, the place and the attribution as fields, and what the
    severity model thinks (a column of `df`, if it is named) beside the severity that stands."""
    place = F.struct(F.col("place").alias("name"), "country", "lat", "lon", "precision")
    who = F.when(F.col("platform").isNotNull(), F.struct("platform", "channel"))
    model = F.struct(scores.severity_name(F.col(opinion)).alias("severity"), (F.col(opinion) != F.col("severity")).alias("disagrees")) if opinion else F.lit(None).cast("struct<severity:string,disagrees:boolean>")
    return df.select(
        "id", "source", "kind", "tier", "status", "event_type", scores.severity_name(F.col("severity")).alias("severity"), "received", "occurred", F.substring(content, 1, excerpt).alias("excerpt"),
        F.when(F.col("lat").isNotNull() | F.col("place").isNotNull(), place).alias("location"), who.alias("attribution"), model.alias("opinion"),
    )


def coverage(observations: DataFrame, token: str, now: int) -> dict[str, DataFrame]:
    """What the window's observations cover, and how many have no place."""
    inside = A.within(observations, "received", now - window(token)[0] * HOUR, now).where("status <> 'Duplicate'")
    by = {name: A.counts_by(inside.where(F.col(name).isNotNull()), name) for name in ("source", "precision", "country", "tier", "platform")}
    language = inside.groupBy(F.coalesce(F.lower("declared_language"), F.lower("detected_language"), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))
    return by | {"language": language, "unplaced": inside.where("lat is null").agg(F.count("*").alias("n"))}


def operations(holdings: dict[str, tuple[DataFrame, str, int]], now: int) -> DataFrame:
    """One row for each table: rows, first and last time, rows of the last week, and bytes a year at that pace (null
    before a week of history). `holdings` gives each name's rows, their time column and the bytes of a row."""
    week, out = 168 * HOUR, None
    for name, (df, at, size) in holdings.items():
        held = df.agg(F.lit(name).alias("holding"), F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_if(F.col(at) >= now - week).alias("week"), F.lit(size).alias("row_bytes"))
        out = held if out is None else out.unionByName(held)
    pace = F.when(F.col("last") - F.col("first") >= week, F.col("week") * F.lit(365) / 7.0 * F.col("row_bytes"))
    return out.withColumn("bytes_a_year", pace).drop("row_bytes")


def narrative(reports: DataFrame, conflict: str, token: str, now: int, least: int = 5, sources: int = 2, take: int = 40) -> dict[str, DataFrame]:
    """Whether a conflict has enough to be told, and the newest reports a teller would be given."""
    inside = A.within(reports, "received", now - window(token)[0] * HOUR, now).where(F.array_contains("conflicts", conflict))
    counted = inside.agg(F.count("*").alias("reports"), F.count_distinct(F.lower("source")).alias("sources"))
    gate = F.when(F.col("reports") < least, "TooFewReports").when(F.col("sources") < sources, "TooFewSources").otherwise("Offered")
    return {"gate": counted.withColumn("gate", gate), "evidence": A.newest(inside.select("id", "source", "received", "place", "severity"), "received", take, take, "id")}


def severity_model(judged: DataFrame, expected: str = "severity", predicted: str = "predicted") -> dict[str, DataFrame]:
    """How good the severity model is on rows that it has judged."""
    table = M.confusion(judged, expected, predicted)
    return {"classes": M.per_class(table), "summary": M.summary(table)}


def severity_predict(model, rows: DataFrame) -> DataFrame:
    """The model's opinion of each row: every class with its probability, the likeliest first."""
    return M.opinions(model, rows)


def health(depth: int, capacity: int, full: float = 0.8) -> str:
    """State of the queue before the pipeline."""
    return "Degraded" if capacity <= 0 or depth / capacity >= full else "Healthy"
