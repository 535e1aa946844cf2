"""Lexicon building, model choices and the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelle.operators import analytics as A
from sentinelle.operators import lexicon as L
from sentinelle.session import table
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, NOW, Queries

Q = Queries()


def _entries(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("n"), F.floor(k / 5)).alias("key"), k.alias("id"), ((k * 7 % 90) / 50.0).alias("lat"), ((k * 11 % 70) / 50.0).alias("lon"), (F.abs(k * 7919) % 60000).alias("population"),
        F.get(F.array(*[F.lit(x) for x in ("PPL", "PPLA", "ADM1", "XXX")]), (k % 4).cast("int")).alias("feature"), F.when(k % 13 != 0, F.col("c_nationkey")).alias("country"),
    )


@Q.add("gazetteer_admission", ", e AS (SELECT c_custkey AS id, ['PPL', 'PPLA', 'ADM1', 'XXX'][c_custkey % 4 + 1] AS feature, (c_custkey * 7919) % 60000 AS population FROM customer WHERE c_custkey % 13 <> 0) SELECT id, CASE feature WHEN 'ADM1' THEN 'Region' ELSE 'Settlement' END AS precision FROM e WHERE feature <> 'XXX' AND (feature <> 'PPL' OR population >= 5000) AND ((id * 7 % 90) <> 0 OR (id * 11 % 70) <> 0)")
def gazetteer_admission(spark, d):
    return L.admitted(_entries(spark, d)).select("id", "precision")


@Q.add("place_disambiguation")
def place_disambiguation(spark, d):
    return L.disambiguated(_entries(spark, d))


_NESTED = """
WITH RECURSIVE p AS (SELECT r_regionkey AS id, NULL::BIGINT AS parent, r_name AS name, 'AX' AS country FROM region UNION ALL SELECT 1000 + n_nationkey, n_regionkey, 'C' || (n_nationkey % 7), 'C' || n_nationkey FROM nation
  UNION ALL SELECT 1000000 + s_suppkey, 1000 + s_nationkey, 'C' || (s_suppkey % 9), 'C' || s_nationkey FROM supplier UNION ALL SELECT 1000000000 + c_custkey, 1000000 + c_custkey % (SELECT count(*) FROM supplier), 'C' || (c_custkey % 9), 'C' || s_nationkey FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)),
up AS (SELECT id, parent AS ancestor, 1 AS steps FROM p WHERE parent IS NOT NULL UNION ALL SELECT u.id, p.parent, u.steps + 1 FROM up u JOIN p ON p.id = u.ancestor WHERE p.parent IS NOT NULL)"""


def _places(spark, d):
    """Regions, nations, suppliers and customers as places, each inside one of the level above."""
    supplier, n = table(spark, d, "supplier"), table(spark, d, "supplier").count()
    name = lambda c, k: F.concat(F.lit("C"), F.col(c) % k)
    country = F.concat(F.lit("C"), "s_nationkey")
    rows = lambda df, id_, parent, key, where: df.select(id_.cast("long").alias("id"), parent.cast("long").alias("parent"), key.alias("key"), where.alias("country"))
    out = rows(table(spark, d, "region"), F.col("r_regionkey"), F.lit(None), F.col("r_name"), F.lit("AX"))
    out = out.unionByName(rows(table(spark, d, "nation"), F.col("n_nationkey") + 1000, F.col("n_regionkey"), name("n_nationkey", 7), F.concat(F.lit("C"), "n_nationkey")))
    out = out.unionByName(rows(supplier, F.col("s_suppkey") + 1_000_000, F.col("s_nationkey") + 1000, name("s_suppkey", 9), country))
    lives = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % n).alias("s_suppkey")).join(supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    return out.unionByName(rows(lives, F.col("c_custkey") + 1_000_000_000, F.col("s_suppkey") + 1_000_000, name("c_custkey", 9), country))


@Q.add("place_ancestors", _NESTED + " SELECT id, ancestor, steps FROM up", prelude=None)
def place_ancestors(spark, d):
    return L.ancestors(_places(spark, d))


@Q.add("place_deepest_in_country", _NESTED + " SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM up JOIN p AS q ON q.id = up.id WHERE up.ancestor = p.id AND q.name = p.name AND q.country = p.country)", prelude=None)
def place_deepest_in_country(spark, d):
    places = _places(spark, d)
    return L.deepest(places, L.ancestors(places)).select("id")


@Q.add("capitalised_runs", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\p{Lu}[\\p{L}''-]+(?: \\p{Lu}[\\p{L}''-]+)*')))  AS runs FROM documents")
def capitalised_runs(spark, d):
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.size(runs).cast("long").alias("runs"))


@Q.add("capitalised_entities")
def capitalised_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", L.capitalised(F.col("text")).alias("entities"))


@Q.add("conflict_choice_validation", ", c AS (SELECT id, ['K0', 'K1', 'NONE', 'K9', NULL][id % 5 + 1] AS key, (id % 13) / 10.0 AS confidence FROM v_observations) SELECT id, CASE WHEN key IS NULL THEN 'unreadable' WHEN key = 'K9' THEN 'not offered' WHEN confidence > 1 THEN 'confidence' WHEN confidence < 0.35 THEN 'unsure' END AS fault FROM c")
def conflict_choice_validation(spark, d):
    i = F.col("id")
    key = F.get(F.array(*[F.lit(x) for x in ("K0", "K1", "NONE", "K9", None)]), (i % 5).cast("int"))
    body = F.to_json(F.struct(key.alias("key"), (i % 13 / 10).alias("confidence")))
    return V.observations(spark, d).select("id", L.choice_fault(body, F.array(F.lit("K0"), F.lit("K1"))).alias("fault"))


@Q.add("recent_downtime", f", g AS (SELECT source, received, lag(received) OVER (PARTITION BY source ORDER BY received, id) AS before FROM v_observations) SELECT source, before AS starts, received AS ends FROM g WHERE received - before > {2 * HOUR} ORDER BY ends DESC, source LIMIT 50")
def recent_downtime(spark, d):
    gaps = A.gaps(V.observations(spark, d), ["source"], "received", 2 * HOUR)
    return gaps.where(F.col("ends") - F.col("starts") > 2 * HOUR).orderBy(F.desc("ends"), "source").limit(50)


@Q.add("register_order", ", x AS (SELECT unnest(conflicts) AS conflict FROM v_conflicts) SELECT conflict, count(*) AS events, row_number() OVER (ORDER BY count(*) DESC, conflict) AS place FROM x GROUP BY 1")
def register_order(spark, d):
    from pyspark.sql import Window

    counted = V.conflict_reports(spark, d).select(F.explode("conflicts").alias("conflict")).groupBy("conflict").agg(F.count("*").alias("events"))
    # The register has one row for each conflict, so ranking it in one partition is a small sort.
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("events"), "conflict")).cast("long"))


@Q.add("pipeline_counters", f"SELECT kind, count(*) AS processed, count(*) FILTER (status = 'Failed') AS failed, round(avg({NOW} - received) / {HOUR}, 4) AS mean_age_hours FROM v_observations GROUP BY 1")
def pipeline_counters(spark, d):
    o = V.observations(spark, d)
    return o.groupBy("kind").agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "Failed").alias("failed"), F.round(F.avg(F.lit(NOW) - F.col("received")) / HOUR, 4).alias("mean_age_hours"))


@Q.add("set_operations", "SELECT user_id FROM (SELECT user_id FROM v_observations WHERE severity = 4 INTERSECT SELECT user_id FROM v_observations WHERE severity = 0) EXCEPT SELECT user_id FROM v_observations WHERE status = 'Failed' AND severity = 3")
def set_operations(spark, d):
    o = V.observations(spark, d)
    users = lambda where: o.where(where).select("user_id")
    return users("severity = 4").intersect(users("severity = 0")).exceptAll(users("status = 'Failed' and severity = 3").distinct())


QUERIES, ORACLE = Q.QUERIES, Q.ORACLE
