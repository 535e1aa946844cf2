"""Analytics, search, coverage and operations queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentinelle.functions import scores
from sentinelle.operators import analytics as A
from sentinelle.operators import metrics as E
from sentinelle.session import settled, table
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, NOW, Queries

Q = Queries()
WEEK = NOW - 168 * HOUR
_W = "CASE severity WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END"


@Q.add(
    "activity_score_by_window",
    f""", w AS (SELECT * FROM (VALUES ('24h', 24), ('7d', 168), ('30d', 720), ('90d', 2160)) AS t(token, hours)),
s AS (SELECT token, hours, count(id) AS incidents, coalesce(sum({_W} * pow(0.5, greatest(({NOW} - occurred) / {HOUR}.0, 0) / (hours / 4.0))
        * least(3.0, 1 + 0.5 * log2(greatest(evidence, 1))) * (0.4 + 0.6 * confidence)), 0) / (hours / 24.0) AS rate
      FROM w LEFT JOIN v_incidents ON occurred >= {NOW} - hours * {HOUR} AND occurred < {NOW} GROUP BY token, hours)
SELECT token, incidents, round(rate, 4) AS rate_per_day, round(100 * (1 - exp(-rate / 30)), 4) AS score,
       CASE WHEN 100 * (1 - exp(-rate / 30)) < 15 THEN 'Low' WHEN 100 * (1 - exp(-rate / 30)) < 40 THEN 'Moderate'
            WHEN 100 * (1 - exp(-rate / 30)) < 70 THEN 'Elevated' ELSE 'High' END AS band FROM s""",
)
def activity_score_by_window(spark, d):
    return A.activity(V.incidents(spark, d), NOW)


#: Three times at which activity is asked for: on the hour, and inside one.
_NOWS = (NOW, NOW - 5 * HOUR, NOW - 100 * HOUR - 1_234_567_890)


@Q.add(
    "activity_from_stored_bins",
    f""", n AS (SELECT unnest([{", ".join(map(str, _NOWS))}]) AS now), w AS (SELECT * FROM n, (VALUES ('24h', 24), ('7d', 168), ('30d', 720), ('90d', 2160)) AS t(token, hours)),
s AS (SELECT now, token, hours, count(id) AS incidents, coalesce(sum({_W} * pow(0.5, greatest((now - occurred) / {HOUR}.0, 0) / (hours / 4.0))
        * least(3.0, 1 + 0.5 * log2(greatest(evidence, 1))) * (0.4 + 0.6 * confidence)), 0) / (hours / 24.0) AS rate
      FROM w LEFT JOIN v_incidents ON occurred >= now - hours * {HOUR} AND occurred < now GROUP BY now, token, hours)
SELECT now, token, incidents, round(rate, 4) AS rate_per_day FROM s""",
)
def activity_from_stored_bins(spark, d):
    incidents = V.incidents(spark, d)
    bins = settled(A.activity_bins(incidents))
    at = [A.activity_from_bins(bins, incidents, now).select(F.lit(now).alias("now"), "token", "incidents", "rate_per_day") for now in _NOWS]
    return at[0].unionByName(at[1]).unionByName(at[2])


@Q.add(
    "latency_sketch_quantiles",
    " SELECT event_type, count(*) AS n, true AS median_holds, true AS p95_holds FROM v_observations GROUP BY 1",
)
def latency_sketch_quantiles(spark, d):
    """Quantiles of stored daily sketches, merged, held against the exact ranks of what they say."""
    o = V.observations(spark, d).select("event_type", "received", (F.col("received") - F.col("occurred") + F.col("value")).cast("double").alias("latency"))
    daily = settled(E.sketches(o, ["event_type", F.floor(F.col("received") / (24 * HOUR)).alias("day")], "latency"))
    said = E.quantiles(E.merged_sketches(daily, ["event_type"]), {"median": 0.5, "p95": 0.95})
    ranks = o.join(said.select("event_type", "median", "p95"), "event_type").groupBy("event_type").agg(F.count("*").alias("n"), *[F.count_if(F.col("latency") <= F.col(q)).alias(f"_{q}") for q in ("median", "p95")])
    holds = lambda q, share: (F.abs(F.col(f"_{q}") / F.col("n") - share) <= E.RANK_ERROR + 1 / F.col("n")).alias(f"{q}_holds")
    return ranks.select("event_type", "n", holds("median", 0.5), holds("p95", 0.95))


def _series_sql(hours, bucket):
    start, n = NOW - hours * HOUR, hours // bucket
    return f""", s AS (SELECT (occurred - {start}) // {bucket * HOUR} AS bucket, count(*) AS n, count(*) FILTER (severity >= 3) AS elevated
    FROM v_incidents WHERE occurred >= {start} AND occurred < {NOW} GROUP BY 1)
SELECT b::INT AS bucket, {start} + b * {bucket * HOUR} AS starts, coalesce(n, 0) AS n, coalesce(elevated, 0) AS elevated FROM range({n}) AS r(b) LEFT JOIN s ON bucket = b"""


for _token, _hours, _bucket in scores.WINDOWS:
    Q.add(f"incident_timeseries_{_token}", _series_sql(_hours, _bucket))(lambda spark, d, h=_hours, b=_bucket: A.series(V.incidents(spark, d), "occurred", NOW, h, b))


@Q.add(
    "timeseries_sliding_7d",
    f""", s AS (SELECT unnest(range((received // {6 * HOUR} - 27) * {6 * HOUR}, (received // {6 * HOUR} + 1) * {6 * HOUR}, {6 * HOUR})) AS starts, severity FROM v_observations)
SELECT starts, count(*) AS n, count(*) FILTER (severity >= 3) AS elevated FROM s GROUP BY starts""",
)
def timeseries_sliding_7d(spark, d):
    # Counted by step first: a row is read once, and only the few counts are copied into their 28 windows.
    step = V.observations(spark, d).groupBy(F.floor(F.col("received") / (6 * HOUR)).alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= 3).alias("elevated"))
    windows = step.withColumn("starts", F.explode(F.transform(F.sequence(F.col("step") - 27, F.col("step")), lambda k: k * (6 * HOUR))))
    return windows.groupBy("starts").agg(F.sum("n").alias("n"), F.sum("elevated").alias("elevated"))


@Q.add(
    "timeseries_session",
    f""", g AS (SELECT *, CASE WHEN received - lag(received) OVER p >= {6 * HOUR} THEN 1 ELSE 0 END AS new FROM v_observations WINDOW p AS (PARTITION BY user_id ORDER BY received)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY received, id) AS session FROM g)
SELECT user_id, min(received) AS starts, count(*) AS n, sum(severity)::BIGINT AS severities FROM s GROUP BY user_id, session""",
)
def timeseries_session(spark, d):
    s = V.observations(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("severity").alias("severities"))
    return s.select("user_id", V.micros("w.start").alias("starts"), "n", "severities")


@Q.add("count_incidents", "SELECT count(*) AS n FROM v_incidents")
def count_incidents(spark, d):
    return V.incidents(spark, d).agg(F.count("*").alias("n"))


@Q.add("count_correlated", "SELECT count(*) AS n FROM v_incidents WHERE evidence > 1")
def count_correlated(spark, d):
    return V.incidents(spark, d).where("evidence > 1").agg(F.count("*").alias("n"))


@Q.add("count_by_severity", f"SELECT severity, count(*) AS n FROM v_incidents WHERE occurred >= {WEEK} AND occurred < {NOW} GROUP BY 1")
def count_by_severity(spark, d):
    return A.counts_by(A.within(V.incidents(spark, d), "occurred", WEEK, NOW), "severity").orderBy(F.desc("severity"))


for _key in ("event_type", "kind", "status"):
    Q.add(f"count_by_{_key}", f"SELECT {_key}, count(*) AS n FROM v_observations WHERE received >= {WEEK} AND received < {NOW} GROUP BY 1")(
        lambda spark, d, key=_key: A.counts_by(A.within(V.observations(spark, d), "received", WEEK, NOW), key).orderBy(F.desc("n"), key)
    )


@Q.add("count_by_region_top12", "SELECT coalesce(country::VARCHAR, place) AS region, count(*) AS n, min(place) AS label, min(country) AS code FROM v_incidents GROUP BY 1 ORDER BY n DESC, region LIMIT 12")
def count_by_region_top12(spark, d):
    region = F.coalesce(F.col("country").cast("string"), "place").alias("region")
    return V.incidents(spark, d).groupBy(region).agg(F.count("*").alias("n"), F.min("place").alias("label"), F.min("country").alias("code")).orderBy(F.desc("n"), "region").limit(12)


@Q.add("incident_search_recent", f"SELECT id, event_type, occurred, severity FROM v_incidents WHERE occurred >= {WEEK} AND occurred <= {NOW} ORDER BY occurred DESC, id LIMIT 250")
def incident_search_recent(spark, d):
    found = V.incidents(spark, d).where(F.col("occurred").between(WEEK, NOW))
    return A.newest(found, "occurred", 400, 250, "id").select("id", "event_type", "occurred", "severity")


@Q.add("recent_observations", "SELECT id, received, source FROM v_observations ORDER BY received DESC, id LIMIT 100")
def recent_observations(spark, d):
    return A.newest(V.observations(spark, d), "received", 100, 400, "id").select("id", "received", "source")


@Q.add("visible_incidents_filter", "SELECT id, occurred, severity FROM v_incidents WHERE severity >= 2 AND event_type = 'error' AND lat IS NOT NULL")
def visible_incidents_filter(spark, d):
    return V.incidents(spark, d).where("severity >= 2 and event_type = 'error' and lat is not null").orderBy(F.desc("occurred"), "id").select("id", "occurred", "severity")


@Q.add("type_facets", "SELECT DISTINCT event_type FROM v_incidents WHERE severity >= 2")
def type_facets(spark, d):
    return V.incidents(spark, d).where("severity >= 2").select("event_type").distinct().orderBy("event_type")


@Q.add("truncation_probe", f"SELECT least(count(*), 5000) AS shown, count(*) > 5000 AS truncated FROM v_incidents WHERE occurred >= {NOW - 720 * HOUR}")
def truncation_probe(spark, d):
    return A.overfull(V.incidents(spark, d).where(F.col("occurred") >= NOW - 720 * HOUR), 5000)


# --- coverage


@Q.add("coverage_by_precision", "SELECT precision, count(*) AS n FROM v_observations WHERE lat IS NOT NULL GROUP BY 1")
def coverage_by_precision(spark, d):
    return A.counts_by(V.observations(spark, d).where("lat is not null"), "precision")


@Q.add("coverage_by_source", "SELECT source, count(*) AS n, count(lat) AS placed, count(*) - count(lat) AS unplaced FROM v_observations GROUP BY 1")
def coverage_by_source(spark, d):
    return V.observations(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count("lat").alias("placed"), (F.count("*") - F.count("lat")).alias("unplaced"))


@Q.add("coverage_unplaced", "SELECT count(*) - count(lat) AS unplaced, count(*) AS n FROM v_observations")
def coverage_unplaced(spark, d):
    return V.observations(spark, d).agg((F.count("*") - F.count("lat")).alias("unplaced"), F.count("*").alias("n"))


@Q.add(
    "coverage_by_language_merged",
    """, l AS (SELECT lower(declared_language) AS language, count(*) AS n, true AS declared FROM v_observations WHERE declared_language IS NOT NULL GROUP BY 1
      UNION ALL SELECT lower(detected_language), count(*), false FROM v_observations WHERE declared_language IS NULL AND detected_language IS NOT NULL GROUP BY 1
      UNION ALL SELECT 'unknown', count(*), false FROM v_observations WHERE declared_language IS NULL AND detected_language IS NULL)
SELECT language, sum(n)::BIGINT AS n, sum(n) FILTER (declared)::BIGINT AS declared FROM l GROUP BY 1""",
)
def coverage_by_language_merged(spark, d):
    language = F.lower(F.coalesce("declared_language", "detected_language", F.lit("unknown")))
    stated = F.col("declared_language").isNotNull()
    out = V.observations(spark, d).groupBy(language.alias("language")).agg(F.count("*").alias("n"), F.sum(F.when(stated, 1)).alias("declared"))
    return out.orderBy(F.col("language") == "unknown", F.desc("n"), "language")


@Q.add("coverage_tier_platform", "SELECT tier, coalesce(platform, 'none') AS platform, count(*) AS n, count(channel) AS named FROM v_observations GROUP BY 1, 2")
def coverage_tier_platform(spark, d):
    return V.observations(spark, d).groupBy("tier", F.coalesce("platform", F.lit("none")).alias("platform")).agg(F.count("*").alias("n"), F.count("channel").alias("named"))


def _ceilings(spark, d):
    placed = A.counts_by(V.observations(spark, d).where("lat is not null"), "country", name="placed")
    nations = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("country"))
    return nations.join(placed, "country", "left").select("country", "n_name", F.coalesce("placed", F.lit(0).cast("long")).alias("placed"))


_CEILINGS = ", c AS (SELECT n_nationkey AS country, n_name, coalesce(placed, 0) AS placed FROM nation LEFT JOIN (SELECT country, count(*) AS placed FROM v_observations WHERE lat IS NOT NULL GROUP BY 1) ON country = n_nationkey)"
Q.add("country_ceiling_join", _CEILINGS + " SELECT * FROM c")(_ceilings)
Q.add("thinnest_countries", _CEILINGS + " SELECT * FROM c ORDER BY placed, n_name LIMIT 3")(lambda spark, d: _ceilings(spark, d).orderBy("placed", "n_name").limit(3))


@Q.add("theatre_counts", ", t AS (SELECT * FROM (VALUES ('north', 3, 0.0, 90.0, -180.0, 180.0), ('whole', 7, NULL, NULL, NULL, NULL), ('east', 11, -90.0, 90.0, 0.0, 180.0)) AS t(theatre, code, s, n, w, e)) SELECT theatre, count(id) AS n FROM t LEFT JOIN v_observations ON country = code AND (s IS NULL OR (lat BETWEEN s AND n AND lon BETWEEN w AND e)) GROUP BY 1".replace(" AS n FROM", " AS reports FROM"))
def theatre_counts(spark, d):
    theatres = spark.createDataFrame([("north", 3, 0.0, 90.0, -180.0, 180.0), ("whole", 7, None, None, None, None), ("east", 11, -90.0, 90.0, 0.0, 180.0)], "theatre string, code int, s double, n double, w double, e double")
    o = V.observations(spark, d).select("id", "country", "lat", "lon")
    inside = F.col("s").isNull() | (F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
    hits = o.join(F.broadcast(theatres), F.col("country") == F.col("code")).where(inside).groupBy("theatre").agg(F.count("*").alias("reports"))
    return theatres.select("theatre").join(hits, "theatre", "left").select("theatre", F.coalesce("reports", F.lit(0).cast("long")).alias("reports"))


@Q.add("country_extents", "SELECT country, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM v_observations GROUP BY 1")
def country_extents(spark, d):
    return V.observations(spark, d).groupBy("country").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@Q.add("provenance_counts", "SELECT count(*) FILTER (kind = 'Replay') AS recorded, count(*) FILTER (kind IN ('News', 'Satellite')) AS polled, count(*) FILTER (tier = 'UserGenerated') AS collected, count(*) FILTER (status = 'HeldForCorroboration') AS held FROM v_observations")
def provenance_counts(spark, d):
    c = F.col
    return V.observations(spark, d).agg(
        F.count_if(c("kind") == "Replay").alias("recorded"), F.count_if(c("kind").isin("News", "Satellite")).alias("polled"), F.count_if(c("tier") == "UserGenerated").alias("collected"), F.count_if(c("status") == "HeldForCorroboration").alias("held")
    )


@Q.add("share_of_max", "SELECT source, n, round(n / max(n) OVER (), 6) AS share FROM (SELECT source, count(*) AS n FROM v_observations GROUP BY 1)")
def share_of_max(spark, d):
    return A.share_of_largest(A.counts_by(V.observations(spark, d), "source"), "n").withColumn("share", F.round("share", 6))


@Q.add("replay_running_count", "SELECT id, incident, count(*) FILTER (status <> 'Duplicate') OVER (PARTITION BY incident ORDER BY received, id) AS running FROM v_observations WHERE incident IS NOT NULL")
def replay_running_count(spark, d):
    w = Window.partitionBy("incident").orderBy("received", "id").rowsBetween(Window.unboundedPreceding, 0)
    return V.observations(spark, d).where("incident is not null").select("id", "incident", F.count_if(F.col("status") != "Duplicate").over(w).alias("running"))


@Q.add("period_comparison_lag", f"SELECT event_type, week, n, lag(n) OVER (PARTITION BY event_type ORDER BY week) AS before FROM (SELECT event_type, received // {168 * HOUR} AS week, count(*) AS n FROM v_observations GROUP BY 1, 2)")
def period_comparison_lag(spark, d):
    weekly = V.observations(spark, d).groupBy("event_type", F.floor(F.col("received") / (168 * HOUR)).alias("week")).agg(F.count("*").alias("n"))
    return weekly.withColumn("before", F.lag("n").over(Window.partitionBy("event_type").orderBy("week")))


# --- operations


@Q.add("dedup_first_occurrence", ", f AS (SELECT user_id, event_type, k, min((received, id)) AS first FROM v_observations GROUP BY ALL) SELECT id, CASE WHEN (received, id) <> first THEN first[2] END AS duplicate_of FROM v_observations JOIN f USING (user_id, event_type, k)")
def dedup_first_occurrence(spark, d):
    return A.first_seen(V.observations(spark, d), ["user_id", "event_type", "k"], ["received", "id"]).select("id", "duplicate_of")


_HORIZON = NOW - 240 * HOUR


@Q.add("retention_prunable", f"SELECT id, status FROM v_observations WHERE received < {_HORIZON} AND status IN ('Duplicate', 'Failed') AND incident IS NULL")
def retention_prunable(spark, d):
    return V.observations(spark, d).where((F.col("received") < _HORIZON) & F.col("status").isin("Duplicate", "Failed") & F.col("incident").isNull()).select("id", "status")


@Q.add("orphan_inferences_anti", f", i AS (SELECT event_id * 2 AS observation, epoch_us(ts) AS made FROM events) SELECT observation, made FROM i WHERE made < {_HORIZON} AND NOT EXISTS (SELECT 1 FROM v_observations o WHERE o.id = observation AND status <> 'Failed')")
def orphan_inferences_anti(spark, d):
    made = table(spark, d, "events").select((F.col("event_id") * 2).alias("observation"), V.micros("ts").alias("made")).where(F.col("made") < _HORIZON)
    live = V.observations(spark, d).where("status <> 'Failed'").select(F.col("id").alias("observation"))
    return made.join(live, "observation", "left_anti")


@Q.add("operations_holdings", f", t AS (SELECT 'observations' AS holding, count(*) AS n, min(received) AS first, max(received) AS last, count(*) FILTER (received >= {WEEK}) AS week FROM v_observations UNION ALL SELECT 'incidents', count(*), min(occurred), max(occurred), count(*) FILTER (occurred >= {WEEK}) FROM v_incidents) SELECT *, CASE WHEN last - first >= {168 * HOUR} THEN round(week * 365 / 7.0 * 900, 3) END AS bytes_a_year FROM t")
def operations_holdings(spark, d):
    def held(df, name, at):
        return df.agg(F.lit(name).alias("holding"), F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_if(F.col(at) >= WEEK).alias("week"))

    both = held(V.observations(spark, d), "observations", "received").unionByName(held(V.incidents(spark, d), "incidents", "occurred"))
    return both.withColumn("bytes_a_year", F.when(F.col("last") - F.col("first") >= 168 * HOUR, F.round(F.col("week") * F.lit(365) / 7.0 * 900, 3)))


_POLLS = ", p AS (SELECT source, max(received) AS last_poll, CASE WHEN source <> 'src3' THEN (20 + ascii(right(source, 1)) % 5)::BIGINT * 60000000 END AS cadence FROM v_observations GROUP BY source)"


def _polls(spark, d):
    cadence = F.when(F.col("source") != "src3", (20 + F.ascii(F.right("source", F.lit(1))) % 5).cast("long") * 60_000_000)
    return V.observations(spark, d).groupBy("source").agg(F.max("received").alias("last_poll")).withColumn("cadence", cadence)


@Q.add("downtime_gap", _POLLS + f", g AS (SELECT max(last_poll) AS last, min(cadence) AS least, arg_max(source, (last_poll, source)) AS source FROM p) SELECT {NOW} - last AS gap, source, {NOW} - last > greatest(2 * least, 900000000) AS recorded FROM g")
def downtime_gap(spark, d):
    g = _polls(spark, d).agg(F.max("last_poll").alias("last"), F.min("cadence").alias("least"), F.max_by("source", F.struct("last_poll", "source")).alias("source"))
    gap = F.lit(NOW) - F.col("last")
    return g.select(gap.alias("gap"), "source", (gap > F.greatest(2 * F.col("least"), F.lit(900_000_000))).alias("recorded"))


@Q.add("source_liveness", _POLLS + f" SELECT source, last_poll, {NOW} - last_poll <= 3 * cadence AS live FROM p WHERE last_poll IS NOT NULL AND cadence IS NOT NULL")
def source_liveness(spark, d):
    return _polls(spark, d).where("last_poll is not null and cadence is not null").select("source", "last_poll", (F.lit(NOW) - F.col("last_poll") <= 3 * F.col("cadence")).alias("live"))


@Q.add("collector_caps", ", i AS (SELECT * FROM v_observations WHERE platform IS NOT NULL AND channel IS NOT NULL), a AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY platform, channel ORDER BY received, id) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY platform ORDER BY received, id) <= 8) SELECT id, platform, channel FROM b ORDER BY received, id LIMIT 40")
def collector_caps(spark, d):
    return A.capped(V.observations(spark, d).where("platform is not null and channel is not null"), ["received", "id"]).select("id", "platform", "channel")


@Q.add("channel_health", f"SELECT platform, channel, count(DISTINCT received // {24 * HOUR}) AS rounds, count(*) AS posts, count(*) FILTER (incident IS NOT NULL) AS contributed, max(received) AS last FROM v_observations WHERE channel IS NOT NULL GROUP BY 1, 2")
def channel_health(spark, d):
    o = V.observations(spark, d).where("channel is not null")
    return o.groupBy("platform", "channel").agg(F.count_distinct(F.floor(F.col("received") / (24 * HOUR))).alias("rounds"), F.count("*").alias("posts"), F.count("incident").alias("contributed"), F.max("received").alias("last"))


@Q.add("bundle_latest_per_channel", f"SELECT lower(channel) AS channel, status, bundle FROM (SELECT *, received // {24 * HOUR} AS bundle, row_number() OVER (PARTITION BY lower(channel) ORDER BY received DESC, id) AS r FROM v_observations WHERE channel IS NOT NULL) WHERE r = 1")
def bundle_latest_per_channel(spark, d):
    o = V.observations(spark, d).where("channel is not null").withColumn("bundle", F.floor(F.col("received") / (24 * HOUR)))
    # The newest row of a channel by partial aggregation, not by sorting each channel.
    return o.groupBy(F.lower("channel").alias("channel")).agg(F.min_by(F.struct("status", "bundle"), F.struct(-F.col("received"), "id")).alias("x")).select("channel", "x.status", "x.bundle")


@Q.add("bundle_set_equality", f", b AS (SELECT received // {24 * HOUR} AS bundle, list_sort(list(DISTINCT source)) AS sources FROM v_observations GROUP BY 1) SELECT x.bundle, x.sources = y.sources AS same FROM b x JOIN b y ON y.bundle = x.bundle - 1")
def bundle_set_equality(spark, d):
    b = V.observations(spark, d).groupBy(F.floor(F.col("received") / (24 * HOUR)).alias("bundle")).agg(F.sort_array(F.collect_set("source")).alias("sources"))
    before = b.select((F.col("bundle") + 1).alias("bundle"), F.col("sources").alias("before"))
    return b.join(before, "bundle").select("bundle", (F.col("sources") == F.col("before")).alias("same"))


@Q.add("bundle_prunable", f"SELECT DISTINCT received // {24 * HOUR} AS bundle FROM v_observations WHERE received < {NOW - 28 * 24 * HOUR}")
def bundle_prunable(spark, d):
    return V.observations(spark, d).where(F.col("received") < NOW - 28 * 24 * HOUR).select(F.floor(F.col("received") / (24 * HOUR)).alias("bundle")).distinct()


@Q.add("collector_verdict", f", r AS (SELECT user_id, received // {24 * HOUR} AS day, count(*) AS read, count(channel) AS matched FROM v_observations GROUP BY 1, 2) SELECT *, CASE WHEN read < 2 THEN 'ALARM' WHEN matched = 0 THEN 'QUIET' ELSE 'COMMIT' END AS verdict FROM r")
def collector_verdict(spark, d):
    r = V.observations(spark, d).groupBy("user_id", F.floor(F.col("received") / (24 * HOUR)).alias("day")).agg(F.count("*").alias("read"), F.count("channel").alias("matched"))
    return r.withColumn("verdict", F.when(F.col("read") < 2, "ALARM").when(F.col("matched") == 0, "QUIET").otherwise("COMMIT"))


@Q.add("evidence_by_incident", f"SELECT o.id, o.incident, o.received FROM v_observations o WHERE o.incident IN (SELECT incident FROM v_observations WHERE severity = 4 AND received >= {WEEK})")
def evidence_by_incident(spark, d):
    o = V.observations(spark, d)
    grave = o.where((F.col("severity") == 4) & (F.col("received") >= WEEK)).select("incident")
    return o.join(grave, "incident", "left_semi").select("id", "incident", "received")


@Q.add("snapshot_meta", "SELECT count(*) AS processed, count(*) FILTER (status = 'Duplicate') AS duplicates, count(*) FILTER (lat IS NULL) AS unresolved, count(*) FILTER (incident IS NOT NULL) AS correlated FROM v_observations")
def snapshot_meta(spark, d):
    c = F.col
    return V.observations(spark, d).agg(F.count("*").alias("processed"), F.count_if(c("status") == "Duplicate").alias("duplicates"), F.count_if(c("lat").isNull()).alias("unresolved"), F.count_if(c("incident").isNotNull()).alias("correlated"))


@Q.add("status_rules", "SELECT count(*) FILTER (status = 'Duplicate' AND incident IS NOT NULL) AS duplicate_linked, count(*) FILTER (status = 'Persisted' AND incident IS NULL) AS persisted_unlinked, count(*) FILTER (status = 'HeldForCorroboration' AND tier <> 'UserGenerated') AS held_published FROM v_observations")
def status_rules(spark, d):
    c = F.col
    return V.observations(spark, d).agg(
        F.count_if((c("status") == "Duplicate") & c("incident").isNotNull()).alias("duplicate_linked"),
        F.count_if((c("status") == "Persisted") & c("incident").isNull()).alias("persisted_unlinked"),
        F.count_if((c("status") == "HeldForCorroboration") & (c("tier") != "UserGenerated")).alias("held_published"),
    )


@Q.add("queue_saturation", f", h AS (SELECT received // {HOUR} AS hour, count(*) AS depth FROM v_observations GROUP BY 1) SELECT count(*) AS hours, max(depth) AS deepest, count(*) FILTER (depth >= 0.8 * 20) AS saturated FROM h")
def queue_saturation(spark, d):
    h = V.observations(spark, d).groupBy(F.floor(F.col("received") / HOUR)).agg(F.count("*").alias("depth"))
    return h.agg(F.count("*").alias("hours"), F.max("depth").alias("deepest"), F.count_if(F.col("depth") >= 0.8 * 20).alias("saturated"))


# --- extras that the reporting side asks for


@Q.add("cube_severity_type", "SELECT severity, event_type, count(*) AS n, grouping(severity) * 2 + grouping(event_type) AS level FROM v_observations GROUP BY CUBE (severity, event_type)")
def cube_severity_type(spark, d):
    return V.observations(spark, d).cube("severity", "event_type").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@Q.add("rollup_country_source", "SELECT country, source, count(*) AS n FROM v_observations GROUP BY ROLLUP (country, source)")
def rollup_country_source(spark, d):
    return V.observations(spark, d).rollup("country", "source").agg(F.count("*").alias("n"))


@Q.add("approx_distinct_sources")
def approx_distinct_sources(spark, d):
    return V.observations(spark, d).groupBy("country").agg(F.approx_count_distinct("user_id").alias("users"))


@Q.add("asof_previous_event", "SELECT a.id, b.id AS before FROM (SELECT * FROM v_observations WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT user_id, received, max(id) AS id FROM v_observations WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.received > b.received")
def asof_previous_event(spark, d):
    o = V.observations(spark, d).where(F.col("event_type").isin("error", "click"))
    w = Window.partitionBy("user_id").orderBy("received").rangeBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type") == "click", F.struct("received", "id"))
    return o.withColumn("before", F.max(click).over(w)["id"]).where("event_type = 'error'").select("id", "before")


QUERIES, ORACLE = Q.QUERIES, Q.ORACLE
