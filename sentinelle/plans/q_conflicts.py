"""Conflict queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sentinelle.operators import conflicts as C
from sentinelle.session import table
from sentinelle.sources import views as V
from sentinelle.sources.views import HOUR, NOW, Queries

Q = Queries()
DAY = 24 * HOUR
WEEK = 7 * DAY


@Q.add("conflict_tally", ", x AS (SELECT unnest(conflicts) AS conflict, source, incident FROM v_conflicts) SELECT conflict, count(*) AS reports, count(DISTINCT lower(source)) AS sources, count(DISTINCT incident) AS incidents FROM x GROUP BY 1")
def conflict_tally(spark, d):
    return C.tally(V.conflict_reports(spark, d))


@Q.add(
    "conflict_tempo_verdicts",
    f""", x AS (SELECT unnest(conflicts) AS conflict, lower(source) AS source, received >= {NOW - WEEK} AS now FROM v_conflicts WHERE received >= {NOW - 2 * WEEK} AND received < {NOW}),
s AS (SELECT conflict, count(*) FILTER (now) AS reports, count(*) FILTER (NOT now) AS before, count(DISTINCT source) FILTER (now) AS sources, count(DISTINCT source) FILTER (NOT now) AS sources_before FROM x GROUP BY 1),
c AS (SELECT *, (reports - before) / nullif(before, 0) AS e, coalesce((sources - sources_before) / nullif(sources_before, 0), 0) AS o, (reports / sources - before / sources_before) / (before / sources_before) AS p FROM s)
SELECT conflict, reports, before, sources, sources_before, CASE WHEN before = 0 THEN 'NoBaseline' WHEN reports < 5 OR before < 5 THEN 'TooThin' WHEN e <= -0.2 AND o <= -0.2 THEN 'NotStated'
  WHEN e >= 0.2 AND o >= 0.2 THEN CASE WHEN p >= 0.2 THEN 'Rising' ELSE 'NotStated' END WHEN abs(e) < 0.2 THEN 'Steady' WHEN e > 0 THEN 'Rising' ELSE 'Falling' END AS verdict FROM c""",
)
def conflict_tempo_verdicts(spark, d):
    return C.tempo(V.conflict_reports(spark, d), "received", NOW, WEEK)


@Q.add("conflict_undecided_counts", "SELECT count(*) FILTER (len(conflicts) = 0 AND candidates > 0) AS undecided, count(*) FILTER (len(conflicts) = 0 AND candidates = 0) AS unassigned FROM v_conflicts")
def conflict_undecided_counts(spark, d):
    none = F.size("conflicts") == 0
    return V.conflict_reports(spark, d).agg(F.count_if(none & (F.col("candidates") > 0)).alias("undecided"), F.count_if(none & (F.col("candidates") == 0)).alias("unassigned"))


@Q.add("conflict_evidence_for_key", "SELECT id, received FROM v_conflicts WHERE list_contains(conflicts, 'K3') ORDER BY received DESC, id LIMIT 40")
def conflict_evidence_for_key(spark, d):
    return V.conflict_reports(spark, d).where(F.array_contains("conflicts", "K3")).orderBy(F.desc("received"), "id").limit(40).select("id", "received")


@Q.add("effective_time_activity", f"SELECT coalesce(occurred, received) // {DAY} AS day, count(*) AS n FROM v_conflicts GROUP BY 1")
def effective_time_activity(spark, d):
    return V.conflict_reports(spark, d).groupBy(F.floor(F.coalesce("occurred", "received") / DAY).alias("day")).agg(F.count("*").alias("n"))


def _register(spark, d):
    """One conflict for each nation: its region's words are its actors' tokens."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    tokens = C.actor_tokens(F.concat_ws(" ", "r_name", "n_name"))
    return both.select(F.concat(F.lit("C"), "n_nationkey").alias("key"), (F.col("n_nationkey") * 3).cast("int").alias("code"), tokens.alias("tokens"), F.array(F.concat(F.lit("P"), F.col("n_nationkey") % 40)).alias("places"), (F.col("n_nationkey") % 20).cast("int").alias("country"), (F.col("n_nationkey") % 7).alias("events"))


def _claims(spark, d):
    return V.observations(spark, d).where("severity >= 3").select(
        "id", F.when(F.col("id") % 7 == 0, F.col("id") % 90).cast("int").alias("code"), F.when(F.col("id") % 2 == 0, F.array(F.lit("asia"), F.lit("china"))).otherwise(F.array(F.lit("europe"))).alias("tokens"), "place", "country"
    )


_MEMBERS = """, g AS (SELECT 'C' || n_nationkey AS key, n_nationkey * 3 AS code, list_distinct(list_filter(regexp_extract_all(lower(r_name || ' ' || n_name), '[\\p{L}\\p{Nd}]+'), lambda w: length(w) >= 3)) AS tokens, 'P' || (n_nationkey % 40) AS place, n_nationkey % 20 AS country FROM nation JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT id, CASE WHEN id % 7 = 0 THEN id % 90 END AS code, CASE WHEN id % 2 = 0 THEN ['asia', 'china'] ELSE ['europe'] END AS tokens, place, country FROM v_observations WHERE severity >= 3),
m AS (SELECT id, key, greatest(CASE WHEN o.code = g.code THEN 4 ELSE 0 END, CASE WHEN len(list_intersect(o.tokens, g.tokens)) > 0 THEN 3 ELSE 0 END, CASE WHEN o.country = g.country AND o.place = g.place THEN 2 ELSE 0 END, CASE WHEN o.country = g.country THEN 1 ELSE 0 END) AS basis, len(list_intersect(o.tokens, g.tokens)) AS shared FROM o, g),
k AS (SELECT * FROM m WHERE basis > 0)"""


@Q.add("conflict_membership_bases", _MEMBERS + " SELECT basis, count(*) AS n, sum(shared)::BIGINT AS shared FROM k GROUP BY 1")
def conflict_membership_bases(spark, d):
    return C.memberships(_claims(spark, d), _register(spark, d)).groupBy("basis").agg(F.count("*").alias("n"), F.sum("shared").alias("shared"))


@Q.add("conflict_membership_strongest", _MEMBERS + """, l1 AS (SELECT id, max(basis) AS top, list({'b': -basis, 'e': -(substr(key, 2)::INT % 7), 'key': key, 'shared': shared} ORDER BY -basis, -(substr(key, 2)::INT % 7), key) AS ms FROM k GROUP BY id),
l2 AS (SELECT *, list_filter(ms, lambda m: m.b = -top) AS best FROM l1),
l3 AS (SELECT *, list_max(list_transform(best, lambda m: m.shared)) AS most FROM l2),
l4 AS (SELECT *, list_filter(best, lambda m: m.shared = most) AS named FROM l3),
l5 AS (SELECT *, CASE WHEN top = 4 THEN best WHEN top = 3 THEN CASE WHEN len(named) > 8 OR (len(named) > 1 AND most < 2) THEN [] ELSE named END WHEN len(best) = 1 THEN best ELSE [] END AS goes,
  top = 3 AND len(named) > 8 AND most >= 2 AS many FROM l4)
SELECT id, top AS basis, array_to_string(list_transform(goes[1:8], lambda m: m.key), ',') AS conflicts,
  array_to_string(list_transform(CASE WHEN many THEN named ELSE list_filter(ms, lambda m: NOT list_contains(list_transform(goes, lambda x: x.key), m.key)) END[1:8], lambda m: m.key), ',') AS candidates FROM l5""")
def conflict_membership_strongest(spark, d):
    out = C.assigned(C.memberships(_claims(spark, d), _register(spark, d)), _register(spark, d))
    return out.withColumns({c: F.array_join(c, ",") for c in ("conflicts", "candidates")})


_PARTS = ", p AS (SELECT 'C' || p_partkey AS key, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS tokens FROM part), u AS (SELECT key, unnest(tokens) AS token FROM p), c AS (SELECT token FROM u GROUP BY 1 HAVING count(*) > 0.1 * (SELECT count(*) FROM p))"


@Q.add("actor_token_idf_prune", _PARTS + " SELECT token, count(*) AS uses FROM u WHERE token NOT IN (SELECT token FROM c) GROUP BY 1")
def actor_token_idf_prune(spark, d):
    register = table(spark, d, "part").select(F.concat(F.lit("C"), "p_partkey").alias("key"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tokens"))
    return C.pruned_tokens(register).groupBy("token").agg(F.count("*").alias("uses"))


@Q.add("conflict_register_build", ", x AS (SELECT unnest(conflicts) AS conflict, * FROM v_conflicts), n AS (SELECT conflict, country, count(*) AS c FROM x GROUP BY 1, 2), f AS (SELECT conflict, arg_max(country, (c, -country)) AS country FROM n GROUP BY 1) SELECT conflict, count(*) AS events, sum(k)::BIGINT AS deaths, any_value(f.country) AS country, count(DISTINCT place) AS places FROM x JOIN f USING (conflict) GROUP BY 1")
def conflict_register_build(spark, d):
    x = V.conflict_reports(spark, d).select("*", F.explode("conflicts").alias("conflict"))
    country = x.groupBy("conflict", "country").agg(F.count("*").alias("c")).groupBy("conflict").agg(F.max_by("country", F.struct("c", -F.col("country"))).alias("country"))
    sums = x.groupBy("conflict").agg(F.count("*").alias("events"), F.sum("k").alias("deaths"), F.count_distinct("place").alias("places"))
    return sums.join(country, "conflict").select("conflict", "events", "deaths", "country", "places")


@Q.add("register_country_backing", ", x AS (SELECT DISTINCT unnest(conflicts) AS conflict, country, place FROM v_conflicts WHERE lat IS NOT NULL), b AS (SELECT conflict, country, count(*) AS places FROM x GROUP BY 1, 2) SELECT * FROM b WHERE places >= 2")
def register_country_backing(spark, d):
    x = V.conflict_reports(spark, d).where("lat is not null").select(F.explode("conflicts").alias("conflict"), "country", "place").distinct()
    return x.groupBy("conflict", "country").agg(F.count("*").alias("places")).where("places >= 2")


@Q.add("conflict_panel_share", ", x AS (SELECT unnest(conflicts) AS conflict, country FROM v_conflicts) SELECT conflict, count(*) AS n, round(100.0 * count(DISTINCT country) / 25, 3) AS seen_percent FROM x GROUP BY 1")
def conflict_panel_share(spark, d):
    x = V.conflict_reports(spark, d).select(F.explode("conflicts").alias("conflict"), "country")
    return x.groupBy("conflict").agg(F.count("*").alias("n"), F.round(100.0 * F.count_distinct("country") / 25, 3).alias("seen_percent")).orderBy(F.desc("n"), "conflict")


@Q.add("narrative_gate", f", x AS (SELECT unnest(conflicts) AS conflict, source FROM v_conflicts WHERE received >= {NOW - 6 * HOUR}), s AS (SELECT conflict, count(*) AS reports, count(DISTINCT lower(source)) AS sources FROM x GROUP BY 1) SELECT *, CASE WHEN reports < 5 THEN 'TooFewReports' WHEN sources < 2 THEN 'TooFewSources' ELSE 'Offered' END AS gate FROM s")
def narrative_gate(spark, d):
    s = C.tally(V.conflict_reports(spark, d).where(F.col("received") >= NOW - 6 * HOUR)).drop("incidents")
    return s.withColumn("gate", F.when(F.col("reports") < 5, "TooFewReports").when(F.col("sources") < 2, "TooFewSources").otherwise("Offered"))


@Q.add("narrative_evidence_pack", ", x AS (SELECT unnest(conflicts) AS conflict, id, received, source FROM v_conflicts), r AS (SELECT *, row_number() OVER (PARTITION BY conflict ORDER BY received DESC, id) AS r FROM x) SELECT conflict, string_agg(id::VARCHAR, ',' ORDER BY r) AS ids, count(DISTINCT source) AS sources FROM r WHERE r <= 40 GROUP BY 1")
def narrative_evidence_pack(spark, d):
    x = V.conflict_reports(spark, d).select(F.explode("conflicts").alias("conflict"), "id", "received", "source")
    w = Window.partitionBy("conflict").orderBy(F.desc("received"), "id")
    top = x.withColumn("r", F.row_number().over(w)).where("r <= 40")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s.id.cast("string")), ",")
    return top.groupBy("conflict").agg(ids.alias("ids"), F.count_distinct("source").alias("sources"))


@Q.add(
    "control_assessment",
    f""", c AS (SELECT lower(place) AS place, received AS made, id % 5 = 0 OR user_id % 40 = 9 AS withdrawal, id % 9 = 0 AS coded, 'A' || (CASE WHEN user_id % 4 = 0 THEN id ELSE user_id % 40 END % 3) AS actor, lower(source) AS source FROM v_observations WHERE received >= {NOW - 90 * DAY} AND received < {NOW}),
g AS (SELECT *, max(made) OVER (PARTITION BY place) AS newest FROM c WHERE NOT withdrawal),
s AS (SELECT place, max(newest) AS newest, count(*) AS claims, bool_or(coded) AS coded, count(DISTINCT source) AS sources, count(DISTINCT lower(actor)) FILTER (made >= newest - {14 * DAY}) AS actors, arg_max(actor, (made, actor)) AS holder FROM g GROUP BY 1),
v AS (SELECT p.place, CASE WHEN claims IS NULL OR (NOT coded AND sources < 2) THEN 'Insufficient' WHEN actors > 1 THEN 'Contested' WHEN newest < {NOW - 30 * DAY} THEN 'Stale' ELSE 'Assessed' END AS verdict, holder, coalesce(claims, 0) AS claims
      FROM (SELECT DISTINCT place FROM c) p LEFT JOIN s USING (place))
SELECT place, verdict, CASE WHEN verdict = 'Assessed' THEN holder END AS holder, claims FROM v""",
)
def control_assessment(spark, d):
    i, u = F.col("id"), F.col("user_id")
    actor = F.concat(F.lit("A"), F.when(u % 4 == 0, i).otherwise(u % 40) % 3)
    claims = V.observations(spark, d).select("place", F.col("received").alias("at"), F.when((i % 5 == 0) | (u % 40 == 9), "WithdrawalReported").otherwise("TerritoryTransferred").alias("signal"), (i % 9 == 0).alias("coded"), actor.alias("actor"), "source")
    return C.control(claims, NOW, DAY)


QUERIES, ORACLE = Q.QUERIES, Q.ORACLE
