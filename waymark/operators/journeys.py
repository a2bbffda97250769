"""Photographs to sessions, stops, outings and trips."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.functions.geo import EARTH_M, metres
from waymark.functions.keys import content_key
from waymark.sources.shipping import ship

DAY_US = 86_400_000_000


def located(photos: DataFrame) -> DataFrame:
    """Photographs that join journeys: a missing kind is a camera photograph, screenshots stay out, a place is needed."""
    return photos.filter((F.col("kind").isNull() | (F.col("kind") == "photo")) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def gap_sessions(photos: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Photographs with ``session``: the instant at which their run without a silence over the limit began.

    Photographs of one stretch as long as the limit are of one session, so sessions begin at stretches alone. What is put in order is
    a row an owner and stretch, counted before the shuffle: no photograph is, so an owner with very many does not end in one task.
    """
    limit = cfg.max_gap_s * 1_000_000
    stretch = F.col("t") - F.pmod("t", F.lit(max(1, int(limit))))
    order = Window.partitionBy("owner_id").orderBy("stretch")
    ends = photos.groupBy("owner_id", stretch.alias("stretch")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    gap = F.col("first") - F.lag("last").over(order)
    ends = ends.withColumn("starts", F.when(gap.isNull() | (gap > limit), F.col("first")))
    ends = ends.select("owner_id", "stretch", F.max("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
    return photos.withColumn("stretch", stretch).join(ends, ["owner_id", "stretch"]).drop("stretch")


def point_metres(a: float, b: float, c: float, d: float) -> float:
    p, q = radians(a), radians(c)
    x = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(d - b) / 2) ** 2
    return 2 * EARTH_M * asin(sqrt(min(1.0, x)))


class OpenStop:
    """The stop that photographs of one session are added to in order; it holds sums, ends and ids.

    A photograph stays with the stop while it is near the centre so far, or has come from its predecessor at a drifting pace;
    photographs at one instant have no pace.
    """

    def __init__(self, cfg: Settings = DEFAULT):
        self.cfg, self.ids = cfg, []

    def joins(self, t: int, lat: float, lon: float) -> bool:
        if not self.ids:
            return True
        gap, n = (t - self.t1) / 1e6, len(self.ids)
        if gap > self.cfg.max_gap_s:
            return False
        if point_metres(self.y / n, self.x / n, lat, lon) <= self.cfg.stay_radius_m:
            return True
        return gap > 0 and point_metres(self.at[0], self.at[1], lat, lon) / 1000 / (gap / 3600) <= self.cfg.drift_kmh

    def add(self, t: int, lt: int, lat: float, lon: float, photo_id) -> None:
        if not self.ids:
            self.t0, self.lt0, self.y, self.x = t, lt, 0.0, 0.0
        self.t1, self.lt1, self.at = t, lt, (lat, lon)
        self.y, self.x = self.y + lat, self.x + lon
        self.ids.append(photo_id)

    def row(self, owner) -> tuple:
        n = len(self.ids)
        return owner, self.t0, self.t1, self.lt0, self.lt1, self.y / n, self.x / n, n, self.ids


def stop_groups(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, cfg: Settings = DEFAULT) -> np.ndarray:
    """Group number of each photograph of one session, in order."""
    out, group, stop = [], 0, OpenStop(cfg)
    for i, (at, y, x) in enumerate(zip(t.tolist(), lat.tolist(), lon.tolist())):
        if not stop.joins(at, y, x):
            group, stop = group + 1, OpenStop(cfg)
        stop.add(at, at, y, x, i)
        out.append(group)
    return np.array(out, int)


STOP_SCHEMA = "owner_id long, t0 long, t1 long, lt0 long, lt1 long, lat double, lon double, n_photos long, photo_ids array<string>"
_STOP_TYPES = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.int64(), pa.list_(pa.string())]
_STOP_NAMES = [c.split()[0] for c in STOP_SCHEMA.split(", ")]


def stops(photos: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Groups of photographs taken at one place, with ``is_stay``; the others were taken in transit.

    The fold depends on order. The silence cut makes sessions independent, so sessions are dealt out and sorted by Spark, and a
    task folds its sorted rows with nothing in memory but a batch and the open stop.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stop, done = None, OpenStop(cfg), []
        for batch in batches:
            for owner, session, photo_id, t, lt, lat, lon in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, session) != key or not stop.joins(t, lat, lon):
                    if stop.ids:
                        done.append(stop.row(key[0]))
                    key, stop = (owner, session), OpenStop(cfg)
                stop.add(t, lt, lat, lon, photo_id)
            yield _stop_batch(done)
            done = []
        yield _stop_batch([stop.row(key[0])] if stop.ids else [])

    ship(photos.sparkSession)
    rows = gap_sessions(located(photos), cfg).select("owner_id", "session", "photo_id", "t", "lt", "lat", "lon")
    groups = rows.repartition("owner_id", "session").sortWithinPartitions("owner_id", "session", "t", "photo_id").mapInArrow(fold, STOP_SCHEMA)
    stay = (F.col("t1") - F.col("t0") >= cfg.min_stay_s * 1_000_000) | (F.col("n_photos") >= cfg.min_photos)
    return groups.withColumn("is_stay", stay)


def _stop_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_STOP_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _STOP_TYPES)], names=_STOP_NAMES)


def stays(photos: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Stops that are stays, with ``stop``: their first photograph, which no other stop has."""
    return stops(photos, cfg).filter("is_stay").drop("is_stay").withColumn("stop", F.get("photo_ids", F.lit(0)))


def numbered_stops(stays: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Stays with ``outing`` (a number per owner): a new one after a silence of more than the longest absence.

    It works by owner and day; what a day takes over is the end of the last stay before it and how
    many outings have begun, one row per owner and day.
    """
    rows = stays.withColumn("day", F.floor(F.col("t0") / DAY_US))
    own = Window.partitionBy("owner_id", "day").orderBy("t0", "t1")
    by_day = Window.partitionBy("owner_id").orderBy("day")
    last = rows.groupBy("owner_id", "day").agg(F.max_by("t1", F.struct("t0", "t1")).alias("last")).withColumn("carried", F.lag("last").over(by_day)).drop("last")
    rows = rows.withColumn("prev", F.lag("t1").over(own)).join(last, ["owner_id", "day"])
    new = F.when(F.col("t0") - F.coalesce("prev", "carried") <= cfg.max_absence_s * 1_000_000, 0).otherwise(1)
    rows = rows.withColumn("new", new).drop("prev", "carried")
    begun = rows.groupBy("owner_id", "day").agg(F.sum("new").alias("n")).withColumn("carried", F.coalesce(F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(begun, ["owner_id", "day"]).withColumn("outing", F.sum("new").over(own) + F.col("carried")).drop("new", "carried", "day")


def outings(numbered: DataFrame) -> DataFrame:
    """One row an outing: its content key, range, stops, photographs and kilometres between consecutive stops."""
    w = Window.partitionBy("owner_id", "outing").orderBy("t0", "t1")
    leg = metres(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    return numbered.withColumn("leg", leg).groupBy("owner_id", "outing").agg(
        content_key(F.flatten(F.collect_list("photo_ids"))).alias("outing_id"),
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("lt0").alias("lt0"), F.max("lt1").alias("lt1"),
        F.count("*").alias("n_stops"), F.sum("n_photos").alias("n_photos"), (F.coalesce(F.sum("leg"), F.lit(0.0)) / 1000).alias("km"),
    )


def nearest_origin(stops: DataFrame, origins: DataFrame) -> DataFrame:
    """Stops with ``home_m``, the distance to their owner's nearest origin (owner_id, lat, lon); stops of owners without one go.

    One join: an owner's origins, few and far fewer than the stops, come as one array.
    """
    o = origins.groupBy("owner_id").agg(F.collect_list(F.struct("lat", "lon")).alias("origins"))
    d = F.array_min(F.transform("origins", lambda p: metres(F.col("lat"), F.col("lon"), p["lat"], p["lon"])))
    return stops.join(o, "owner_id").withColumn("home_m", d).drop("origins")


def trips(numbered: DataFrame, origins: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Runs of outings that were away as a whole, without a long silence between them, over at least one night."""
    per = nearest_origin(numbered, origins).groupBy("owner_id", "outing").agg(F.min("home_m").alias("least"), F.max("home_m").alias("most"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("lt0").alias("lt0"), F.max("lt1").alias("lt1"))
    w = Window.partitionBy("owner_id").orderBy("t0")
    per = per.withColumn("away", F.col("least") >= cfg.trip_away_m)
    joined = F.col("away") & F.lag("away").over(w) & (F.col("t0") - F.lag("t1").over(w) <= cfg.trip_gap_s * 1_000_000)
    per = per.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(w)).filter("away")
    day = lambda c: F.floor(F.col(c) / DAY_US)
    return (
        per.groupBy("owner_id", "run")
        .agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("lt0").alias("lt0"), F.max("lt1").alias("lt1"), F.count("*").alias("n_outings"), (F.max("most") / 1000).alias("farthest_km"), F.collect_list("outing").alias("outings"))
        .withColumn("nights", day("lt1") - day("lt0"))
        .filter("nights >= 1")
    )


def trips_newest_first(trips: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """An owner's latest trips with ``rank``, newest first."""
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("t0")))
    return trips.withColumn("rank", rank).filter(F.col("rank") <= cfg.trips_shown)


def outing_photographs(numbered: DataFrame) -> DataFrame:
    """(owner_id, outing_id, nth, photo_id): the photographs of each outing's stops, in the order of the stops."""
    nth = F.row_number().over(Window.partitionBy("owner_id", "outing").orderBy("t0", "t1"))
    ids = outings(numbered).select("owner_id", "outing", "outing_id")
    rows = numbered.withColumn("nth", nth).join(ids, ["owner_id", "outing"])
    return rows.select("owner_id", "outing_id", "nth", F.explode("photo_ids").alias("photo_id"))
