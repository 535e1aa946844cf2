"""The engine's tables, derived from the test tables by integer arithmetic.

`received` and `occurred` are microseconds of the epoch; `ts` is kept beside them, so that windows reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.session import table

#: The reports' "now": 2024-01-31 00:00:00 UTC.
NOW = 1_706_659_200_000_000
HOUR = 3_600_000_000

# Straits and canals, as (name, latitude, longitude, watch radius in km).
CHOKEPOINTS = (
    ("Bab-el-Mandeb", 12.585, 43.334, 120.0),
    ("Strait of Hormuz", 26.567, 56.250, 120.0),
    ("Suez Canal", 30.500, 32.350, 60.0),
    ("Strait of Malacca", 3.000, 100.500, 150.0),
    ("Taiwan Strait", 24.500, 119.500, 150.0),
    ("Panama Canal", 9.080, -79.680, 60.0),
    ("Kerch Strait", 45.300, 36.500, 60.0),
    ("Gulf of Aden", 12.500, 47.500, 200.0),
)


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    pick = lambda key, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int") + 1)
    e = e.withColumn("received", micros("ts"))
    located = i % 11 != 0
    status = F.when(i % 20 == 0, "Duplicate").when(i % 20 == 1, "Failed").when(i % 20 == 2, "HeldForCorroboration").otherwise("Persisted")
    return e.select(
        i.alias("id"),
        u.alias("user_id"),
        "ts",
        "received",
        (F.col("received") - (i % 90) * 60_000_000).alias("occurred"),
        F.concat(F.lit("src"), u % 7).alias("source"),
        "event_type",
        F.when(F.col("value") < 20, 0).when(F.col("value") < 50, 1).when(F.col("value") < 100, 2).when(F.col("value") < 200, 3).otherwise(4).alias("severity"),
        "value",
        (u % 25).cast("int").alias("country"),
        F.concat(F.lit("P"), u % 40).alias("place"),
        pick(i, "Settlement", "Region", "Country", "Exact").alias("precision"),
        F.when(located, ((u * 37 + 11) % 181 - 90) * 0.97).alias("lat"),
        F.when(located, ((u * 53 + 7) % 361 - 180) * 0.99).alias("lon"),
        status.alias("status"),
        pick(i, "News", "Satellite", "ExternalEvent", "Manual", "Replay").alias("kind"),
        F.when(i % 3 == 0, "UserGenerated").otherwise("Published").alias("tier"),
        F.when(i % 3 == 0, pick(i, "telegram", "bluesky", "mastodon", "x")).alias("platform"),
        F.when((i % 3 == 0) & (i % 8 != 0), F.concat(F.lit("ch"), u % 13)).alias("channel"),
        F.when(i % 6 == 0, "en").when(i % 6 == 1, "UK").when(i % 6 == 2, "ru").alias("declared_language"),
        F.when(i % 5 == 0, "EN").when(i % 5 == 1, "fr").alias("detected_language"),
        F.when(i % 20 > 2, F.concat_ws(":", "event_type", u, F.floor(F.col("received") / (24 * HOUR)))).alias("incident"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.groupBy("event_type", "user_id", F.floor(F.col("received") / (24 * HOUR)).alias("day")).agg(
        F.count("*").alias("evidence"),
        F.max("severity").alias("severity"),
        F.min("received").alias("occurred"),
        (F.min("id") % 100 / 100.0).alias("confidence"),
        F.max("lat").alias("lat"),
        F.max("lon").alias("lon"),
        F.max("country").alias("country"),
        F.max("place").alias("place"),
        F.min("id").alias("id"),
    )


def conflict_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the conflicts they belong to (0 to 2) and how many more are possible."""
    o = observations(spark, sf_dir)
    key = lambda n: F.concat(F.lit("K"), n)
    keys = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).when(F.col("id") % 4 == 1, F.array(key(F.col("user_id") % 9), key(F.col("user_id") % 9 + 1))).otherwise(F.array(key(F.col("user_id") % 9)))
    return o.where("status <> 'Duplicate'").withColumn("conflicts", keys).withColumn("candidates", (F.col("id") % 3).cast("int"))


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.select(
        "id",
        "received",
        F.to_date("ts").alias("day"),
        (((F.col("user_id") * 37 + F.col("id") % 3) % 181 - 90) * 0.97).alias("lat"),
        (((F.col("user_id") * 53 + F.col("id") % 2) % 361 - 180) * 0.99).alias("lon"),

        F.when(F.col("id") % 13 != 0, F.col("value")).alias("power"),
        (F.col("id") % 3 != 0).alias("night"),
        F.when(F.col("id") % 5 == 0, "h").when(F.col("id") % 5 == 1, "n").when(F.col("id") % 5 == 2, "l").when(F.col("id") % 5 == 3, (F.col("id") % 140).cast("string")).otherwise("?").alias("said"),
    )


def chokepoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHOKEPOINTS), "name string, c_lat double, c_lon double, radius double")


#: The same tables in DuckDB's SQL.
PRELUDE = f"""
WITH v_observations AS (
  SELECT event_id AS id, user_id, ts, epoch_us(ts) AS received, epoch_us(ts) - (event_id % 90) * 60000000 AS occurred,
    'src' || (user_id % 7) AS source, event_type,
    CASE WHEN value < 20 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 WHEN value < 200 THEN 3 ELSE 4 END AS severity, value,
    (user_id % 25)::INT AS country, 'P' || (user_id % 40) AS place,
    ['Settlement', 'Region', 'Country', 'Exact'][event_id % 4 + 1] AS precision,
    CASE WHEN event_id % 11 <> 0 THEN ((user_id * 37 + 11) % 181 - 90) * 0.97::DOUBLE END AS lat,
    CASE WHEN event_id % 11 <> 0 THEN ((user_id * 53 + 7) % 361 - 180) * 0.99::DOUBLE END AS lon,
    CASE event_id % 20 WHEN 0 THEN 'Duplicate' WHEN 1 THEN 'Failed' WHEN 2 THEN 'HeldForCorroboration' ELSE 'Persisted' END AS status,
    ['News', 'Satellite', 'ExternalEvent', 'Manual', 'Replay'][event_id % 5 + 1] AS kind,
    CASE WHEN event_id % 3 = 0 THEN 'UserGenerated' ELSE 'Published' END AS tier,
    CASE WHEN event_id % 3 = 0 THEN ['telegram', 'bluesky', 'mastodon', 'x'][event_id % 4 + 1] END AS platform,
    CASE WHEN event_id % 3 = 0 AND event_id % 8 <> 0 THEN 'ch' || (user_id % 13) END AS channel,
    CASE event_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'UK' WHEN 2 THEN 'ru' END AS declared_language,
    CASE event_id % 5 WHEN 0 THEN 'EN' WHEN 1 THEN 'fr' END AS detected_language,
    CASE WHEN event_id % 20 > 2 THEN event_type || ':' || user_id || ':' || (epoch_us(ts) // {24 * HOUR}) END AS incident,
    (props->>'$.k')::INT AS k
  FROM events),
v_incidents AS (
  SELECT event_type, user_id, received // {24 * HOUR} AS day, count(*) AS evidence, max(severity) AS severity, min(received) AS occurred,
    min(id) % 100 / 100.0 AS confidence, max(lat) AS lat, max(lon) AS lon, max(country) AS country, max(place) AS place, min(id) AS id
  FROM v_observations GROUP BY ALL),
v_conflicts AS (
  SELECT *, CASE WHEN id % 4 = 0 THEN []::VARCHAR[] WHEN id % 4 = 1 THEN ['K' || (user_id % 9), 'K' || (user_id % 9 + 1)] ELSE ['K' || (user_id % 9)] END AS conflicts,
    id % 3 AS candidates
  FROM v_observations WHERE status <> 'Duplicate'),
v_fire AS (
  SELECT id, received, ts::DATE AS day, ((user_id * 37 + id % 3) % 181 - 90) * 0.97::DOUBLE AS lat, ((user_id * 53 + id % 2) % 361 - 180) * 0.99::DOUBLE AS lon,
    CASE WHEN id % 13 <> 0 THEN value END AS power, id % 3 <> 0 AS night,
    CASE id % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'n' WHEN 2 THEN 'l' WHEN 3 THEN (id % 140)::VARCHAR ELSE '?' END AS said
  FROM v_observations),
v_choke AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE, {r}::DOUBLE)" for n, a, o, r in CHOKEPOINTS)}) AS t(name, c_lat, c_lon, radius))
"""

#: Haversine distance in DuckDB's SQL.
KM = "(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2)))))"


class Queries:
    """Queries of one module with the SQL that checks them."""

    def __init__(self):
        self.QUERIES: dict = {}
        self.ORACLE: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, prelude: str = PRELUDE):
        def keep(f):
            self.QUERIES[name] = f
            if sql is not None:
                self.ORACLE[name] = (prelude + sql) if prelude else sql
            return f

        return keep
