"""Correlation, corroboration, metrics and model queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentinelle.functions import text as X
from sentinelle.operators import analytics as A
from sentinelle.operators import correlate as R
from sentinelle.operators import mentions as M
from sentinelle.operators import metrics as E
from sentinelle.plans.q_text import _TOKENS as TOKENS
from sentinelle.session import table
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, KM, Queries

Q = Queries()


def content(spark, d):
    """The words and actors that the opening of every document names."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    actors = F.slice(F.array_distinct(F.regexp_extract_all(F.substring("text", 1, 200), F.lit("[A-Z][a-z]{7,}"), F.lit(0))), 1, 4)
    return docs.select(F.col("doc_id").alias("said"), X.tokens(F.col("text"), 400).alias("tokens"), actors.alias("actors"))


def placed(spark, d):
    """Observations with the document whose opening they say, and whose claim they are."""
    identity = F.when(F.col("channel").isNotNull(), F.concat_ws("/", "platform", "channel"))
    columns = ("id", "received", "occurred", "event_type", "lat", "lon", "precision", "place")
    said = F.pmod("id", F.lit(table(spark, d, "documents").count())).alias("said")
    return V.observations(spark, d).select(*columns, said, (F.col("tier") == "UserGenerated").alias("claim"), identity.alias("identity"))


def reports(spark, d):
    """Observations with the words and actors that the opening of a document names."""
    return placed(spark, d).join(content(spark, d), "said").drop("said")


DAY = 24 * HOUR
_REPORTS = f""", t AS (SELECT doc_id, {TOKENS.format("coalesce(text, '')").replace("2000", "400")} AS tokens, list_filter(regexp_extract_all(substr(coalesce(text, ''), 1, 200), '[A-Z][a-z]{{7,}}'), lambda x, i: list_position(regexp_extract_all(substr(coalesce(text, ''), 1, 200), '[A-Z][a-z]{{7,}}'), x) = i)[1:4] AS actors FROM documents),
s AS (SELECT o.*, tokens, actors FROM v_observations o JOIN t ON t.doc_id = o.id % (SELECT count(*) FROM documents))"""
_PAIRS = f"""{_REPORTS},
p AS (SELECT a.id AS a, b.id AS b, a.occurred AS at_a, b.occurred AS at_b, lower(a.place) = lower(b.place) AS same, a.precision = 'Country' AND b.precision = 'Country' AS country,
        CASE WHEN a.precision <> 'Country' AND b.precision <> 'Country' THEN {KM.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} END AS km,
        coalesce(round_even(len(list_intersect(a.tokens, b.tokens)) / nullif(sqrt(len(a.tokens)::DOUBLE * len(b.tokens)), 0), 4), 0) AS sim, len(list_intersect(a.actors, b.actors)) AS shared,
        CASE WHEN len(a.actors) > 0 AND len(b.actors) > 0 THEN round_even(len(list_intersect(a.actors, b.actors)) / len(a.actors), 4) END AS overlap
      FROM s a JOIN s b ON a.event_type = b.event_type AND abs(a.occurred - b.occurred) <= {DAY}
      QUALIFY b.id < a.id AND row_number() OVER (PARTITION BY a.id ORDER BY b.occurred DESC, b.id) <= 200),
c AS (SELECT *, CASE WHEN km IS NOT NULL THEN CASE WHEN km <= 75 THEN 1 - 0.45 * km / 75 END WHEN country AND same THEN 0.55 WHEN same THEN 0.55 WHEN sim >= 0.4 AND shared > 0 THEN 0.6 END AS cap FROM p),
f AS (SELECT *, round(cap * (0.6 + 0.4 * CASE WHEN overlap IS NOT NULL THEN (overlap + sim) / 2 ELSE sim END), 3) AS score FROM c)"""


def _scored(spark, d):
    """Every report with those of lesser id, among its newest candidates, that place, or wording and actors, can join it to."""
    return R.scored(placed(spark, d), content(spark, d), DAY)


@Q.add("correlation_candidates_interval", f"SELECT o.id AS a, least(200, count(*))::BIGINT AS candidates, max(i.occurred) AS newest FROM v_observations o JOIN v_incidents i ON i.event_type = o.event_type AND abs(i.occurred - o.occurred) <= {DAY} GROUP BY 1")
def correlation_candidates_interval(spark, d):
    return R.candidates(V.observations(spark, d), V.incidents(spark, d), DAY).withColumnRenamed("id", "a")


@Q.add("held_claim_candidates", f""", h AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY b.received, b.id) AS r FROM v_observations a JOIN v_observations b ON a.event_type = b.event_type AND abs(a.occurred - b.occurred) <= {DAY}
  WHERE b.status = 'HeldForCorroboration') SELECT a, b FROM h WHERE r <= 50""")
def held_claim_candidates(spark, d):
    """For every report the 50 oldest held claims of its type within a day: these rows are made and no others."""
    o = V.observations(spark, d)
    held, none = o.where("status = 'HeldForCorroboration'"), F.lit(None).cast("long")
    claims = held.select("event_type", F.col("received").alias("o1"), F.col("id").alias("o2"), F.lit(0).cast("long").alias("o3"), "occurred", F.col("received").alias("born1"), F.col("id").alias("born2"), none.alias("gone1"), none.alias("gone2"))
    # No claim of the window was received later than the slowest of all.
    slowest = held.agg(F.max(F.col("received") - F.col("occurred"))).first()[0] or 0
    lo, hi = F.col("occurred") - DAY, F.col("occurred") + DAY
    asks = o.select("event_type", F.col("id").alias("ask"), F.lit(R.SWEEP).alias("most"), lo.alias("start"), (hi + slowest).alias("stop"), lo.alias("lo"), hi.alias("hi"), F.lit(1 << 62).alias("now1"), F.lit(0).cast("long").alias("now2"))
    return R.nth(claims, asks, DAY // 16, each=True).select(F.col("ask").alias("a"), F.col("o2").alias("b"))


@Q.add("correlation_pair_score", _PAIRS + " SELECT a, b, score FROM f WHERE score >= 0.45")
def correlation_pair_score(spark, d):
    return _scored(spark, d).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "score")


@Q.add("correlation_best_earlier", _PAIRS + " SELECT a, arg_max(b, (score, at_b, -b)) AS b, max(score) AS score FROM f WHERE score >= 0.45 AND at_b < at_a GROUP BY 1")
def correlation_best_earlier(spark, d):
    earlier = _scored(spark, d).where("occurred_b < occurred_a")
    return earlier.groupBy(F.col("id_a").alias("a")).agg(F.max_by("id_b", F.struct("score", "occurred_b", -F.col("id_b"))).alias("b"), F.max("score").alias("score"))


@Q.add("corroboration_pairs", f"""{_REPORTS}, h AS (SELECT * FROM s WHERE tier = 'UserGenerated' AND channel IS NOT NULL)
SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.event_type = b.event_type AND a.id < b.id AND abs(a.occurred - b.occurred) <= {DAY} WHERE a.platform || '/' || a.channel <> b.platform || '/' || b.channel
  AND CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL AND a.precision <> 'Country' AND b.precision <> 'Country' THEN {KM.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 25
      ELSE a.place = b.place AND NOT (a.lat IS NOT NULL AND a.precision = 'Country') AND NOT (b.lat IS NOT NULL AND b.precision = 'Country')
        AND (len(list_intersect(a.actors, b.actors)) > 0 OR round_even(len(list_intersect(a.tokens, b.tokens)) / nullif(sqrt(len(a.tokens)::DOUBLE * len(b.tokens)), 0), 4) >= 0.4) END""")
def corroboration_pairs(spark, d):
    return R.corroborated(reports(spark, d).where("claim"), DAY).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@Q.add("incident_rollup", "SELECT incident, count(*) AS observations, max(severity) AS severity, arg_min(event_type, (received, id)) AS event_type, min(occurred) AS occurred, arg_min(lat, (received, id)) FILTER (lat IS NOT NULL) AS lat, max(value) AS confidence, array_to_string(list_sort(list(DISTINCT source))[1:40], ',') AS sources FROM v_observations WHERE incident IS NOT NULL GROUP BY 1")
def incident_rollup(spark, d):
    o = V.observations(spark, d).withColumn("confidence", F.col("value"))
    return R.rollup(o, "incident", ["received", "id"]).withColumn("sources", F.array_join("sources", ","))


@Q.add("correlate_greedy_assign")
def correlate_greedy_assign(spark, d):
    return R.correlated(reports(spark, d), DAY)


@Q.add("correlation_components", f""", b AS (SELECT *, CASE WHEN occurred - lag(occurred) OVER w > {HOUR} THEN 1 ELSE 0 END AS gap FROM v_observations WINDOW w AS (PARTITION BY event_type ORDER BY occurred, id)),
c AS (SELECT event_type, 1 + sum(gap) OVER (PARTITION BY event_type ORDER BY occurred, id) AS component FROM b) SELECT event_type, component::BIGINT AS component, count(*) AS n FROM c GROUP BY 1, 2""")
def correlation_components(spark, d):
    return R.components(V.observations(spark, d).select("id", "event_type", "occurred"), ["event_type"], "occurred", HOUR).groupBy("event_type", "component").agg(F.count("*").alias("n"))


_MANIFEST = """
WITH m AS (SELECT l_orderkey, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT l_orderkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey)
SELECT l_orderkey AS id, count(DISTINCT lower(name)) AS names, sha256(string_agg(DISTINCT lower(name), '|' ORDER BY lower(name))) AS names_sha256 FROM m GROUP BY 1"""


@Q.add("place_mentions_automaton", _MANIFEST, prelude=None)
def place_mentions_automaton(spark, d):
    """The names of parts, suppliers and customers that the manifests of all orders mention, found in their texts."""
    part, supplier, customer = (table(spark, d, t) for t in ("part", "supplier", "customer"))
    line = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    said = line.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("a "), "p_name", F.lit(" from "), F.upper("s_name"))), "; ").alias("goods"))
    order = table(spark, d, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")
    texts = said.join(order, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("id"), F.concat(F.lit("("), "c_name", F.lit(") gets "), "goods", F.lit(".")).alias("text"))
    lexicon = part.select(F.col("p_name").alias("name")).unionByName(supplier.select(F.col("s_name").alias("name"))).unionByName(customer.select(F.col("c_name").alias("name")))
    found = M.mentioned(texts, lexicon, most=1000)
    return found.select("id", F.size("mentions").cast("long").alias("names"), F.sha2(F.array_join(F.array_sort("mentions"), "|"), 256).alias("names_sha256"))


# --- metrics


def _judged(spark, d):
    o = V.observations(spark, d)
    return o.select("id", F.col("severity").alias("expected"), F.when(F.col("id") % 3 == 0, F.col("severity")).otherwise((F.col("id") % 5).cast("int")).alias("got"))


_JUDGED = """, j AS (SELECT severity AS expected, CASE WHEN id % 3 = 0 THEN severity ELSE id % 5 END AS got FROM v_observations),
k AS (SELECT u.klass, (SELECT count(*) FROM j WHERE expected = u.klass) AS support, (SELECT count(*) FROM j WHERE got = u.klass) AS given, (SELECT count(*) FROM j WHERE expected = u.klass AND got = u.klass) AS hit FROM (SELECT DISTINCT expected AS klass FROM j UNION SELECT DISTINCT got FROM j) u),
m AS (SELECT klass, support, hit / nullif(given, 0) AS p, hit / nullif(support, 0) AS r FROM k)"""


@Q.add("classification_metrics", _JUDGED + " SELECT klass::INT AS klass, support, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m")
def classification_metrics(spark, d):
    out = E.per_class(E.confusion(_judged(spark, d), "expected", "got"))
    return out.select("klass", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@Q.add("classification_summary", _JUDGED + " SELECT round((SELECT count(*) FILTER (expected = got) / count(*) FROM j), 6) AS accuracy, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) FILTER (support > 0), 6) AS macro_f1 FROM m")
def classification_summary(spark, d):
    return E.summary(E.confusion(_judged(spark, d), "expected", "got")).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@Q.add("set_prf_metrics", ", s AS (SELECT ['a', 'b' || (id % 3)] AS want, ['a', 'b' || (id % 2), 'c'] AS got FROM v_observations), t AS (SELECT sum(len(list_intersect(want, got))) AS hit, sum(len(got)) AS g, sum(len(want)) AS w FROM s) SELECT round(hit / g, 6) AS precision, round(hit / w, 6) AS recall, round(2 * (hit / g) * (hit / w) / (hit / g + hit / w), 6) AS f1 FROM t")
def set_prf_metrics(spark, d):
    i = F.col("id")
    rows = V.observations(spark, d).select(F.array(F.lit("a"), F.concat(F.lit("b"), i % 3)).alias("want"), F.array(F.lit("a"), F.concat(F.lit("b"), i % 2), F.lit("c")).alias("got"))
    return E.set_scores(rows, "want", "got").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@Q.add("latency_nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM v_observations GROUP BY 1")
def latency_nearest_rank_percentile(spark, d):
    return A.nearest_ranks(V.observations(spark, d), "event_type", "value", {"median": 0.5, "p95": 0.95})


@Q.add("placement_reach_by_region", ", r AS (SELECT n_regionkey AS region, country, count(*) AS events, count(lat) AS placed, sum(k) AS deaths FROM v_observations JOIN nation ON n_nationkey = country GROUP BY 1, 2) SELECT region, count(*) AS conflicts, count(*) FILTER (placed * 1.1 >= events) AS reached, round(sum(placed) / sum(events), 6) AS coverage FROM r GROUP BY 1")
def placement_reach_by_region(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("country"), F.col("n_regionkey").alias("region"))
    # Counts by country first: the join then meets one row for each country.
    by = V.observations(spark, d).groupBy("country").agg(F.count("*").alias("events"), F.count("lat").alias("placed"), F.sum("k").alias("deaths"))
    return by.join(n, "country").groupBy("region").agg(F.count("*").alias("conflicts"), F.count_if(F.col("placed") * 1.1 >= F.col("events")).alias("reached"), F.round(F.sum("placed") / F.sum("events"), 6).alias("coverage"))


@Q.add("placement_worst20", ", r AS (SELECT country, count(*) AS events, count(lat) AS placed, sum(k)::BIGINT AS deaths FROM v_observations GROUP BY 1) SELECT country, deaths FROM r WHERE placed / events < 0.92 ORDER BY deaths DESC, country LIMIT 20")
def placement_worst20(spark, d):
    by = V.observations(spark, d).groupBy("country").agg(F.count("*").alias("events"), F.count("lat").alias("placed"), F.sum("k").alias("deaths"))
    return by.where(F.col("placed") / F.col("events") < 0.92).orderBy(F.desc("deaths"), "country").limit(20).select("country", "deaths")


@Q.add("severity_model_predict")
def severity_model_predict(spark, d):
    i = F.col("id")
    o = V.observations(spark, d).select(
        "id", "severity", "event_type", F.concat_ws(" ", "place", "source", "kind").alias("text"), F.lit(1.0).alias("sources"), (i % 100 / 100).alias("confidence"), (i % 4).cast("double").alias("entities"), F.lit(0.0).alias("located"), (i % 3 != 0).alias("train")
    )
    return E.predictions(o, rounds=10)


QUERIES, ORACLE = Q.QUERIES, Q.ORACLE
