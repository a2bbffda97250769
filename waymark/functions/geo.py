"""Distances on the sphere, and the cell join that turns a nearest-within search into an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371008.8


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    chord = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def kmh(distance_m: Column, seconds: Column) -> Column:
    """Speed; null where no time has passed."""
    return F.try_divide(distance_m * 3.6, seconds)


def contains(lat: Column, lon: Column, radius_m: Column, other_lat: Column, other_lon: Column) -> Column:
    """Whether an area, its edge included, holds a point."""
    return metres(lat, lon, other_lat, other_lon) <= radius_m


def metres_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same as ANSI SQL text."""
    return f"(2 * {EARTH_M} * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"


def with_cells(points: DataFrame, grid: float, ring: int = 0) -> DataFrame:
    """Points with grid cells (cy, cx); with ``ring`` also the cells around them, a row each."""
    y, x = F.floor(F.col("lat") / grid), F.floor(F.col("lon") / grid)
    if not ring:
        return points.withColumns({"cy": y, "cx": x})
    span = F.sequence(F.lit(-ring), F.lit(ring))
    return points.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).withColumns({"cy": y + F.col("dy"), "cx": x + F.col("dx")}).drop("dy", "dx")


def nearest_within(points: DataFrame, names: DataFrame, within_m: float, grid: float = 0.5) -> DataFrame:
    """Points with ``label`` and ``distance_m`` of the nearest name within reach (ties: label), null without one.

    Equi-join on grid cells: every name is copied to the cells around it, as many rings as the reach needs at the latitudes
    up to 60 degrees. ``points`` have key, lat, lon; ``names`` have label, lat, lon.
    """
    ring = max(1, -(-int(within_m) // int(grid * 111_000 * 0.5)))
    cells = with_cells(names, grid, ring).select("cy", "cx", "label", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    d = metres(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    hits = with_cells(points, grid).join(cells, ["cy", "cx"]).withColumn("d", d).filter(F.col("d") <= within_m)
    best = hits.groupBy("key").agg(F.min(F.struct("d", "label")).alias("best"))
    return points.join(best, "key", "left").select(*points.columns, F.col("best.label").alias("label"), F.col("best.d").alias("distance_m"))
