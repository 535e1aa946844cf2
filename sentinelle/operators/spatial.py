"""Radius and watch-area queries: filter by box or grid cell, then refine by exact distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinelle.functions import geo

#: Kilometres of a degree of latitude, a little less than the true least, so that cells never miss a point.
_DEGREE_KM = 110.5


def near_centre(points: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Points within `km` of one centre with their distance; the box around the circle is a plain range filter."""
    box = geo.box_from_radius(F.lit(lat), F.lit(lon), F.lit(km))
    inside = points.where(geo.box_contains(box, F.col("lat"), F.col("lon")))
    return inside.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).where(F.col("km") <= km)


def near_any(points: DataFrame, centres: DataFrame, most_km: float) -> DataFrame:
    """Every (point, centre) within the centre's radius, joined by grid cell.

    `centres` has c_lat, c_lon and radius (at most `most_km`). Each centre is copied to the cells its circle can
    touch, so the join is by equality and no pair outside neighbouring cells is ever made.
    """
    size = most_km / _DEGREE_KM
    rows = F.expr(f"sequence(cast(floor(greatest(c_lat - {size}, -90.0) / {size}) as int), cast(floor(least(c_lat + {size}, 90.0) / {size}) as int))")
    spots = centres.withColumn("_y", F.explode(rows))
    # The widest a circle gets, in degrees of longitude; one that holds a pole goes all the way round.
    polar = F.abs(F.col("c_lat")) + size >= 90
    step = F.when(polar, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(size))) / F.cos(F.radians("c_lat"))))))
    n_around = F.ceil(F.lit(360.0) / size).cast("int")
    columns = F.when(step >= 180, F.sequence(F.lit(0), n_around)).otherwise(
        F.transform(F.sequence(F.floor((F.col("c_lon") - step + 180) / size).cast("int"), F.floor((F.col("c_lon") + step + 180) / size).cast("int")), lambda x: F.floor(F.pmod(x * size + size / 2, F.lit(360.0)) / size).cast("int"))
    )
    # Around the seam a cell can be cut short, so its neighbours join as well.
    wider = F.array_distinct(F.flatten(F.transform(columns, lambda x: F.array(x, F.pmod(x + 1, n_around), F.pmod(x - 1, n_around)))))
    spots = spots.withColumn("_x", F.explode(wider))
    at = points.where("lat is not null and lon is not null").withColumns({"_y": F.floor(F.col("lat") / size).cast("int"), "_x": F.least(n_around - 1, F.floor((F.col("lon") + 180) / size).cast("int"))})
    pairs = at.join(spots, ["_y", "_x"]).drop("_y", "_x")
    return pairs.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).where(F.col("km") <= F.col("radius"))


#: Levels of cells: bands of latitude of 180 degrees, 90, 45, ... down to about a kilometre.
LEVELS = 14


def _band(level: Column) -> Column:
    return 180.0 / F.pow(F.lit(2.0), level)


def _row(lat: Column, level: Column) -> Column:
    return F.least(F.floor((lat + 90) / _band(level)), F.pow(F.lit(2.0), level).cast("long") - 1)


def _around(y: Column, level: Column) -> Column:
    """How many cells a band has, so that a circle as wide as the band, wherever its centre is, touches neighbours only."""
    farthest = F.least(F.lit(90.0), F.abs((y + 0.5) * _band(level) - 90) + 1.5 * _band(level))
    # Beyond three cells, which are neighbours all round, a circle's span in longitude is below 1.25 times its own width.
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(farthest)) / (1.25 * _band(level)))).cast("long")


def _column(lon: Column, around: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * around), around)


def near_each(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Every (point, area) within the area's radius, with `km`, for areas of any sizes together.

    `areas` has c_lat, c_lon and radius. An area stands in nine cells at most, of the finest level whose cells are as
    wide as it; a point asks its own cell at every level that has areas, LEVELS + 1 at most. So a small area meets the
    points of its neighbourhood only, whatever the largest one is.
    """
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(180 * _DEGREE_KM / F.greatest("radius", F.lit(1e-6)))))).cast("int")
    placed = areas.where("c_lat is not null and c_lon is not null and radius >= 0").withColumn("_l", level)
    rows = F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: _row(F.col("c_lat"), F.col("_l")) + k)
    inside = F.filter(rows, lambda y: (y >= 0) & (y < F.pow(F.lit(2.0), F.col("_l"))))
    cells = placed.withColumn("_y", F.explode(inside)).withColumn("_n", _around(F.col("_y"), F.col("_l")))
    cells = cells.withColumn("_x", F.explode(F.array_distinct(F.array(*[F.pmod(_column(F.col("c_lon"), F.col("_n")) + k, F.col("_n")) for k in (-1, 0, 1)])))).drop("_n")
    used = sorted(r["_l"] for r in placed.select("_l").distinct().collect())
    at = points.where("lat is not null and lon is not null").withColumn("_l", F.explode(F.array(*[F.lit(x) for x in used]).cast("array<int>")))
    at = at.withColumn("_y", _row(F.col("lat"), F.col("_l")))
    at = at.withColumn("_x", _column(F.col("lon"), _around(F.col("_y"), F.col("_l"))))
    pairs = at.join(cells, ["_l", "_y", "_x"]).drop("_l", "_y", "_x")
    return pairs.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).where(F.col("km") <= F.col("radius"))


def watch_areas(points: DataFrame, areas: DataFrame, most_km: float) -> DataFrame:
    """One row for each area, quiet ones too: reports and the nearest in km (one decimal); busiest first, then nearest, quiet ones last."""
    hits = near_any(points, areas, most_km).groupBy("name").agg(F.count("*").alias("n"), F.min("km").alias("nearest"))
    return areas.join(hits, "name", "left").select("name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.bround("nearest", 1).alias("nearest_km")).orderBy(F.desc("n"), F.asc_nulls_last("nearest_km"), "name")


def persistent_cells(spots: DataFrame, least_days: int = 3) -> DataFrame:
    """Cells of a hundredth of a degree that burn on several days."""
    return spots.groupBy(F.round("lat", 2).alias("cell_lat"), F.round("lon", 2).alias("cell_lon")).agg(F.count_distinct("day").alias("days")).where(F.col("days") >= least_days)


def hotspot_reasons(spots: DataFrame, confidence, floor: float = 10.0, least: int = 50, night_only: bool = True, least_days: int = 3) -> DataFrame:
    """Each hotspot with the first reason to drop it (null: kept)."""
    lasting = persistent_cells(spots, least_days).withColumn("_lasting", F.lit(True))
    keyed = spots.withColumns({"cell_lat": F.round("lat", 2), "cell_lon": F.round("lon", 2), "confidence": confidence})
    reason = (
        F.when(F.coalesce(F.col("confidence"), F.lit(0)) < least, "confidence")
        .when(F.lit(night_only) & ~F.col("night"), "daytime")
        .when(F.col("power") < floor, "power")
        .when(F.col("_lasting"), "persistent")
    )
    return keyed.join(lasting, ["cell_lat", "cell_lon"], "left").withColumn("reason", reason).drop("_lasting", "days")
