"""Spatial queries and hotspots."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentinelle.functions import geo
from sentinelle.operators import analytics as A
from sentinelle.operators import spatial as S
from sentinelle.sources import views as V
from sentinelle.sources.views import CHOKEPOINTS, KM, Queries

Q = Queries()
#: Watch radii are scaled up, since the test points lie on a coarse grid.
SCALE = 8.0
MOST = SCALE * max(c[3] for c in CHOKEPOINTS)


def _areas(spark):
    return V.chokepoints(spark).withColumn("radius", F.col("radius") * SCALE)


def _hits(spark, d):
    return S.near_any(V.incidents(spark, d).select("id", "severity", "lat", "lon"), _areas(spark), MOST)


_HITS = f""", h AS (SELECT *, {KM.format("lat", "lon", "c_lat", "c_lon")} AS km FROM v_incidents, v_choke WHERE lat IS NOT NULL),
n AS (SELECT * FROM h WHERE km <= radius * {SCALE})"""


@Q.add("haversine_distance", f"SELECT id, round({KM.format('lat', 'lon', '12.5', '47.5')}, 3) AS km FROM v_observations WHERE lat IS NOT NULL")
def haversine_distance(spark, d):
    o = V.observations(spark, d).where("lat is not null")
    return o.select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(12.5), F.lit(47.5)), 3).alias("km"))


@Q.add(
    "bounding_box_contains",
    """, b AS (SELECT degrees(1500 / 6371.0088) AS d), x AS (SELECT -17.0 - d AS s, -17.0 + d AS n, d / cos(radians(17.0 + d)) AS w FROM b)
SELECT id FROM v_observations, x WHERE lat BETWEEN s AND n AND (lon >= 178.0 - w OR lon <= 178.0 + w - 360)""",
)
def bounding_box_contains(spark, d):
    box = geo.box_from_radius(F.lit(-17.0), F.lit(178.0), F.lit(1500.0))
    return V.observations(spark, d).where(geo.box_contains(box, F.col("lat"), F.col("lon"))).select("id")


@Q.add("radius_search", f"SELECT id, round({KM.format('lat', 'lon', '26.567', '56.25')}, 3) AS km FROM v_incidents WHERE {KM.format('lat', 'lon', '26.567', '56.25')} <= 1500 ORDER BY km, id LIMIT 50")
def radius_search(spark, d):
    return S.near_centre(V.incidents(spark, d).select("id", "lat", "lon"), 26.567, 56.25, 1500.0).select("id", F.round("km", 3).alias("km")).orderBy("km", "id").limit(50)


@Q.add("chokepoint_activity", _HITS + " SELECT c.name, count(n.id) AS n, round(min(km), 1) AS nearest_km FROM v_choke c LEFT JOIN n ON n.name = c.name GROUP BY 1")
def chokepoint_activity(spark, d):
    areas = S.watch_areas(V.incidents(spark, d).select("id", "lat", "lon"), _areas(spark), MOST)
    return areas


@Q.add("chokepoint_severity", _HITS + " SELECT name, severity, count(*) AS n FROM n GROUP BY 1, 2")
def chokepoint_severity(spark, d):
    return A.counts_by(_hits(spark, d), "name", "severity").orderBy("name", F.desc("severity"))


@Q.add("chokepoint_top10_nearest", _HITS + " SELECT name, id, rank FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY round(km, 2), id) AS rank FROM n) WHERE rank <= 10")
def chokepoint_top10_nearest(spark, d):
    return A.top_per_group(_hits(spark, d).withColumn("km", F.round("km", 2)), ["name"], ["km", "id"], 10).select("name", "id", F.col("rank").cast("long").alias("rank"))


@Q.add("maritime_summary", _HITS + " , a AS (SELECT c.name, count(n.id) AS n FROM v_choke c LEFT JOIN n ON n.name = c.name GROUP BY 1) SELECT count(*) AS watched, count(*) FILTER (n > 0) AS active, sum(n)::BIGINT AS total, arg_max(name, (n, name)) AS busiest FROM a")
def maritime_summary(spark, d):
    areas = S.watch_areas(V.incidents(spark, d).select("id", "lat", "lon"), _areas(spark), MOST)
    return areas.agg(F.count("*").alias("watched"), F.count_if(F.col("n") > 0).alias("active"), F.sum("n").alias("total"), F.max_by("name", F.struct("n", "name")).alias("busiest"))


@Q.add("spatial_join_grid", f""", c AS (SELECT DISTINCT country, min(lat) OVER (PARTITION BY country) AS c_lat, min(lon) OVER (PARTITION BY country) AS c_lon FROM v_incidents WHERE lat IS NOT NULL)
SELECT c.country AS centre, count(*) AS n FROM c, v_incidents i WHERE i.lat IS NOT NULL AND {KM.format('i.lat', 'i.lon', 'c_lat', 'c_lon')} <= 700 GROUP BY 1""")
def spatial_join_grid(spark, d):
    i = V.incidents(spark, d).where("lat is not null")
    centres = i.groupBy(F.col("country").alias("centre")).agg(F.min("lat").alias("c_lat"), F.min("lon").alias("c_lon")).withColumn("radius", F.lit(700.0))
    return A.counts_by(S.near_any(i.select("id", "lat", "lon"), centres, 700.0), "centre")


@Q.add("containment_mixed_radii", f""", c AS (SELECT id AS area, lat AS c_lat, lon AS c_lon, [1.0, 30.0, 400.0, 2500.0, 5000.0][id % 5 + 1]::DOUBLE AS radius FROM v_incidents WHERE lat IS NOT NULL AND id % 5 < 2 OR lat IS NOT NULL AND id < 60)
SELECT area, count(*) AS n, round(max(km), 3) AS farthest FROM (SELECT area, radius, {KM.format('i.lat', 'i.lon', 'c_lat', 'c_lon')} AS km FROM c, v_incidents i WHERE i.lat IS NOT NULL) WHERE km <= radius GROUP BY 1""")
def containment_mixed_radii(spark, d):
    """Incidents in areas of one kilometre to five thousand, around two fifths of all incidents and the first sixty."""
    i = V.incidents(spark, d).where("lat is not null")
    radius = F.element_at(F.array(*[F.lit(r) for r in (1.0, 30.0, 400.0, 2500.0, 5000.0)]), (F.col("id") % 5 + 1).cast("int"))
    areas = i.where((F.col("id") % 5 < 2) | (F.col("id") < 60)).select(F.col("id").alias("area"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), radius.alias("radius"))
    return S.near_each(i.select("lat", "lon"), areas).groupBy("area").agg(F.count("*").alias("n"), F.round(F.max("km"), 3).alias("farthest"))


# --- hotspots

_CONF = "CASE WHEN said = 'h' THEN 90 WHEN said = 'n' THEN 60 WHEN said = 'l' THEN 20 ELSE least(100, greatest(0, try_cast(said AS INT))) END"


def confidence(said):
    named = F.when(said == "h", 90).when(said == "n", 60).when(said == "l", 20)
    return F.coalesce(named, F.least(F.lit(100), F.greatest(F.lit(0), said.try_cast("int"))))


@Q.add("fire_confidence_parse", f"SELECT id, CASE WHEN try_cast(said AS INT) IS NULL AND said NOT IN ('h', 'n', 'l') THEN NULL ELSE {_CONF} END AS confidence FROM v_fire")
def fire_confidence_parse(spark, d):
    said = F.col("said")
    known = said.isin("h", "n", "l") | said.try_cast("int").isNotNull()
    return V.hotspots(spark, d).select("id", F.when(known, confidence(said)).alias("confidence"))


_CELLS = ", c AS (SELECT round(lat, 2) AS cell_lat, round(lon, 2) AS cell_lon, count(DISTINCT day) AS days FROM v_fire GROUP BY 1, 2 HAVING days >= 12)"


@Q.add("fire_persistent_cells", _CELLS + " SELECT * FROM c")
def fire_persistent_cells(spark, d):
    return S.persistent_cells(V.hotspots(spark, d), 12)


@Q.add("fire_filter_reasons", _CELLS + f""", r AS (SELECT CASE WHEN try_cast(said AS INT) IS NULL AND said = '?' THEN 'confidence' WHEN {_CONF} < 50 THEN 'confidence' WHEN NOT night THEN 'daytime' WHEN power < 10 THEN 'power'
    WHEN days IS NOT NULL THEN 'persistent' END AS reason FROM v_fire LEFT JOIN c ON round(lat, 2) = cell_lat AND round(lon, 2) = cell_lon) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def fire_filter_reasons(spark, d):
    known = F.when(F.col("said") != "?", confidence(F.col("said")))
    return A.counts_by(S.hotspot_reasons(V.hotspots(spark, d), known, least_days=12), F.coalesce("reason", F.lit("kept")).alias("reason"))


@Q.add("drawable_control_places", "SELECT place, max(lat) AS lat FROM v_observations WHERE lat IS NOT NULL AND NOT isnan(lat) AND precision IN ('Settlement', 'Exact') GROUP BY 1")
def drawable_control_places(spark, d):
    return V.observations(spark, d).where(F.col("lat").isNotNull() & ~F.isnan("lat") & F.col("precision").isin("Settlement", "Exact")).groupBy("place").agg(F.max("lat").alias("lat"))


QUERIES, ORACLE = Q.QUERIES, Q.ORACLE
