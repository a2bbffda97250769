"""Places from stays: order-dependent clusterings, anchors, place profiles and what follows from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, cos, floor, radians

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.functions.geo import EARTH_M, metres
from waymark.functions.keys import place_reference
from waymark.operators.journeys import point_metres
from waymark.operators.measures import in_hours, wall_hour, wall_weekday
from waymark.sources.scratch import kept
from waymark.sources.shipping import ship

DAY_US = 86_400_000_000
_POINT = re.compile(r"place:(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)$")


def _all_metres(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lats)
    x = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, x)))


def _step(radius_m: float) -> float:
    """Side of a grid cell: the degrees of latitude that the radius spans, a little more."""
    return radius_m / 111_000


def _cell(lat: float, lon: float, step: float) -> tuple[int, int]:
    return floor(lat / step), floor(lon / step)


def _around(lat: float, lon: float, step: float) -> list[tuple[int, int]] | None:
    """The cells that the radius around a point can touch; None near the poles and the date line, where cells are no help."""
    if abs(lat) >= 85:
        return None
    wide = ceil(1.0 / max(cos(radians(min(89.9, abs(lat) + 2 * step))), 1e-3))
    if 180 - abs(lon) < (wide + 1) * step:
        return None
    cy, cx = _cell(lat, lon, step)
    return [(y, x) for y in (cy - 1, cy, cy + 1) for x in range(cx - wide, cx + wide + 1)]


class Places:
    """Places in order of founding with their running centres, found through grid cells of the centres."""

    def __init__(self, radius_m: float):
        self.radius_m, self.sums, self.cells, self.where = radius_m, [], {}, []
        self.step = _step(radius_m)

    def place(self, lat: float, lon: float) -> int:
        """The first place, in order of founding, whose mean centre lies within the radius, or a new one; the stay joins it."""
        around = _around(lat, lon, self.step)
        near = range(len(self.sums)) if around is None else sorted(i for c in around for i in self.cells.get(c, ()))
        for i in near:
            n, y, x = self.sums[i]
            if point_metres(y / n, x / n, lat, lon) <= self.radius_m:
                break
        else:
            i = len(self.sums)
            self.sums.append((0, 0.0, 0.0))
            self.where.append(None)
        n, y, x = self.sums[i]
        self.sums[i] = n, y, x = n + 1, y + lat, x + lon
        cell = _cell(y / n, x / n, self.step)
        if cell != self.where[i]:
            if self.where[i] is not None:
                self.cells[self.where[i]].discard(i)
            self.where[i] = cell
            self.cells.setdefault(cell, set()).add(i)
        return i


def first_near(lat: np.ndarray, lon: np.ndarray, radius_m: float) -> np.ndarray:
    """Each stay goes to the first place, in order of founding, whose mean centre lies within the radius."""
    places = Places(radius_m)
    return np.array([places.place(y, x) for y, x in zip(lat.tolist(), lon.tolist())], int)


def grown(lat: np.ndarray, lon: np.ndarray, radius_m: float) -> np.ndarray:
    """The first free stay founds a place; passes with a centre fixed for the pass take in all near it until one adds none.

    A pass looks at the stays of the grid cells around the centre only.
    """
    out, place, step, cells = np.full(len(lat), -1), 0, _step(radius_m), {}
    for i, (y, x) in enumerate(zip(lat.tolist(), lon.tolist())):
        cells.setdefault(_cell(y, x, step), []).append(i)
    for first in range(len(lat)):
        if out[first] >= 0:
            continue
        out[first], mine = place, np.array([first])
        while True:
            y, x = lat[mine].mean(), lon[mine].mean()
            around = _around(y, x, step)
            near = np.arange(len(lat)) if around is None else np.array([i for c in around for i in cells.get(c, ())], int)
            near = near[out[near] < 0]
            near = near[_all_metres(y, x, lat[near], lon[near]) <= radius_m]
            if not len(near):
                break
            out[near], mine = place, np.sort(np.concatenate([mine, near]))
        place += 1
    return out


_PLACED = "owner_id long, stop string, t0 long, t1 long, lt0 long, lt1 long, lat double, lon double, n_photos long"
#: Bands in the width of a radius, cuts at most, and the latitude beyond which and the longitude from which on nothing is cut from west to east.
BANDS, CUTS, CUT_LAT, CUT_LON = 4, 6, 80.0, 179.0


def _apart(band: str, gap) -> Column:
    """How many empty stripes wider than ``gap`` bands lie before a band of its region."""
    order = Window.partitionBy("owner_id", "region").orderBy(band)
    wide = F.col(band) - F.lag(band).over(order) > gap
    return F.sum(F.when(wide, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))


def regions(stays: DataFrame, radius_m: float) -> DataFrame:
    """Stays with ``region``: stays of one owner in different regions are never within the radius of each other's places.

    An owner's stays are cut where a stripe from west to east or from south to north, wider than the radius, has no stay; each part is
    cut again the other way, until nothing changes or after ``CUTS`` cuts. A place's centre lies in the box around its stays, so no centre
    comes near a stay on the other side of a stripe, and regions can be folded apart. What is sorted is a row a band, not a stay.
    Near the poles and the date line nothing is cut by longitude.
    """
    deg = _step(radius_m)
    y, x = F.floor(F.col("lat") / (deg / BANDS)), F.floor(F.col("lon") / (deg / BANDS))
    rows = stays.withColumns({"band_y": y, "band_x": x})
    cells = rows.groupBy("owner_id", "band_y", "band_x").agg(F.max(F.abs("lat")).alias("far_y"), F.max(F.abs("lon")).alias("far_x")).withColumn("region", F.lit(0).cast("long"))
    cells = kept(cells, "place-cells")
    found, still = cells.select("owner_id").distinct().count(), 0
    for cut in range(CUTS):
        if cut % 2 == 0:
            bands = cells.select("owner_id", "region", "band_y").distinct()
            parts = bands.withColumn("part", _apart("band_y", F.lit(BANDS + 1)))
            cells = cells.join(parts, ["owner_id", "region", "band_y"])
        else:
            flat = Window.partitionBy("owner_id", "region")
            bands = cells.groupBy("owner_id", "region", "band_x").agg(F.max("far_y").alias("y"), F.max("far_x").alias("x")).withColumns({"y": F.max("y").over(flat), "x": F.max("x").over(flat)})
            gap = F.when((F.col("y") <= CUT_LAT) & (F.col("x") < CUT_LON), F.ceil(1.01 * BANDS / F.cos(F.radians(F.least("y", F.lit(CUT_LAT))))) + 1)
            parts = bands.withColumn("part", F.coalesce(_apart("band_x", gap), F.lit(0))).select("owner_id", "region", "band_x", "part")
            cells = cells.join(parts, ["owner_id", "region", "band_x"])
        # two regions under one hash would be folded together, which changes nothing
        cells = cells.select("owner_id", "band_y", "band_x", "far_y", "far_x", F.when(F.col("part") == 0, F.col("region")).otherwise(F.xxhash64("region", "part", F.lit(cut))).alias("region"))
        cells = kept(cells, "place-cells")
        now = cells.select("owner_id", "region").distinct().count()
        still = still + 1 if now == found else 0
        if still == 2:
            break
        found = now
    return rows.join(cells.select("owner_id", "band_y", "band_x", "region"), ["owner_id", "band_y", "band_x"]).drop("band_y", "band_x")


def placed(stays: DataFrame, radius_m: float, how=first_near) -> DataFrame:
    """Stays with ``place``, a number per owner in order of founding.

    The clusterings depend on order, so the stays (not photographs) of a region of an owner come in order to one task; an owner is as many
    tasks as there are regions (``regions``). By first nearness a task holds a region's places only, not the stays; other clusterings get
    the stays of a region at once. Places are numbered by their first stays, a row a place.
    """
    ship(stays.sparkSession)
    names = [c.split()[0] for c in _PLACED.split(", ")]
    rows = (stays if "stop" in stays.columns else stays.withColumn("stop", F.lit(None).cast("string"))).select(*names)
    rows = regions(rows.filter("lat is not null and lon is not null"), radius_m).select(*names, "region")

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, places = None, Places(radius_m)
        for batch in batches:
            found = []
            for o, r, y, x in zip(*(batch.column(c).to_pylist() for c in ("owner_id", "region", "lat", "lon"))):
                if (o, r) != own:
                    own, places = (o, r), Places(radius_m)
                found.append(places.place(y, x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, "region", "nth"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, done = None, [], []

        def close() -> None:
            rows = pa.Table.from_batches(held)
            found = how(rows.column("lat").to_numpy(), rows.column("lon").to_numpy(), radius_m)
            done.append(rows.append_column("nth", pa.array(found, pa.int64())))
            held.clear()

        for batch in batches:
            keys, begin = list(zip(batch.column("owner_id").to_pylist(), batch.column("region").to_pylist())), 0
            for i, key in enumerate(keys):
                if key != own:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        close()
                    own, begin = key, i
            if begin < len(keys):
                held.append(batch.slice(begin))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done.clear()
        if held:
            close()
            yield from done[0].combine_chunks().to_batches()

    fold = one_by_one if how is first_near else whole
    put = rows.repartition("owner_id", "region").sortWithinPartitions("owner_id", "region", "t0", "t1", "stop").mapInArrow(fold, _PLACED + ", region long, nth long")
    put = kept(put, "placed-regions")
    first = put.groupBy("owner_id", "region", "nth").agg(F.min(F.struct("t0", "t1", "stop")).alias("first"))
    number = F.row_number().over(Window.partitionBy("owner_id").orderBy("first", "region", "nth")).cast("long") - 1
    return put.join(first.select("owner_id", "region", "nth", number.alias("place")), ["owner_id", "region", "nth"]).select(*names, "place")


def _day(c: str):
    return F.floor(F.col(c) / DAY_US)


def visit_days(placed: DataFrame) -> DataFrame:
    """Per place: centre, distinct days of arrival, first and last day, photographs."""
    return placed.groupBy("owner_id", "place").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.countDistinct(_day("lt0")).alias("visit_days"),
        F.min(_day("lt0")).alias("first_day"), F.max(_day("lt0")).alias("last_day"), F.sum("n_photos").alias("n_photos"),
    )


def return_rates(places: DataFrame) -> DataFrame:
    back = (F.col("visit_days") > 1).cast("double")
    return places.groupBy("owner_id").agg(F.count("*").alias("n_places"), F.avg(back).alias("return_rate"), F.avg(1 - back).alias("one_time_rate"))


def top_returned(places: DataFrame, top: int) -> DataFrame:
    """The first ``top`` places by days and photographs, then those of them that were returned to."""
    w = Window.partitionBy("owner_id").orderBy(F.desc("visit_days"), F.desc("n_photos"), "place")
    return places.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= top) & (F.col("visit_days") > 1))


def anchors(stays: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Places of enough distinct days, with the days that touch the night, the working hours and weekdays."""
    rows = placed(stays, cfg.anchor_radius_m, grown)
    mean = rows.groupBy("owner_id", "place").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    day = _day("lt0")
    touches = lambda hours: in_hours(wall_hour(F.col("lt0")), hours) | in_hours(wall_hour(F.col("lt1")), hours)
    rows = rows.join(mean, ["owner_id", "place"])
    got = rows.groupBy("owner_id", "place").agg(
        F.first("clat").alias("lat"), F.first("clon").alias("lon"), F.max(metres(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))).alias("far"),
        F.countDistinct(day).alias("visit_days"), F.countDistinct(F.when(touches(cfg.night_hours), day)).alias("night_days"),
        F.countDistinct(F.when(touches(cfg.working_hours), day)).alias("daytime_days"), F.countDistinct(F.when(wall_weekday(F.col("lt0")) < 5, day)).alias("weekday_days"),
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n_photos").alias("n_photos"),
    )
    got = got.filter(F.col("visit_days") >= cfg.anchor_min_visits)
    return got.withColumns({"radius_m": F.greatest("far", F.lit(cfg.anchor_radius_m)), "confidence": F.least(F.lit(1.0), F.col("visit_days") / (cfg.anchor_min_visits * cfg.anchor_saturation))}).drop("far")


def place_profiles(placed: DataFrame) -> DataFrame:
    """Per place: visits (stays), first and last arrival, and the half-even median of the days between arrivals."""
    w = Window.partitionBy("owner_id", "place").orderBy("t0", "t1")
    gaps = placed.withColumn("gap", _day("lt0") - F.lag(_day("lt0")).over(w))
    return gaps.groupBy("owner_id", "place").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("visits"), F.min("t0").alias("first_t"), F.max("t0").alias("last_t"), F.bround(F.median("gap")).cast("int").alias("gap_days"))


def regular_places(profiles: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The places an owner sets out from: those returned to over a time, else the busiest one."""
    span = F.floor((F.col("last_t") - F.col("first_t")) / DAY_US)
    rows = profiles.withColumn("regular", (F.col("visits") >= cfg.regular_visits) & (span >= cfg.regular_span_days))
    w = Window.partitionBy("owner_id")
    rows = rows.withColumn("any_regular", F.max("regular").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("visits"), "place")))
    return rows.filter(F.col("regular") | (~F.col("any_regular") & (F.col("nth") == 1))).select("owner_id", "place", "lat", "lon")


def with_trip_visits(profiles: DataFrame, placed: DataFrame, trips: DataFrame, numbered: DataFrame) -> DataFrame:
    """Profiles with ``trip_visits``, their stays that belong to trips, and ``only_on_trips``."""
    on = trips.select("owner_id", F.explode("outings").alias("outing"))
    stays = numbered.join(on, ["owner_id", "outing"], "left_semi").select("owner_id", "stop")
    n = placed.join(stays, ["owner_id", "stop"], "left_semi").groupBy("owner_id", "place").agg(F.count("*").alias("trip_visits"))
    return profiles.join(n, ["owner_id", "place"], "left").withColumn("trip_visits", F.coalesce("trip_visits", F.lit(0))).withColumn("only_on_trips", F.col("trip_visits") == F.col("visits"))


def outside_anchors(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places outside every anchor's area of their owner."""
    a = anchors.select("owner_id", F.col("lat").alias("alat"), F.col("lon").alias("alon"), "radius_m")
    inside = places.join(a, "owner_id").filter(metres(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon")) <= F.col("radius_m")).select("owner_id", "place").distinct()
    return places.join(inside, ["owner_id", "place"], "left_anti")


def place_interests(places: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Interests from places of two days and more: topic, score, confidence, first and last day."""
    v, d = F.col("visit_days"), F.col("last_day") - F.col("first_day")
    return places.filter("visit_days > 1").select("owner_id", place_reference(F.col("lat"), F.col("lon")).alias("topic"), (v / (v + 1)).alias("score"), (v / (v + 3) * (d / (d + cfg.span_half_days))).alias("confidence"), "first_day", "last_day")


def place_profile(places: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Places of two days and more (``visit_days``) as a profile's interests: both ends are the evidence, ``pos`` is the place among an owner's places."""
    nth = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("visit_days"), F.desc("n_photos"), "place")).cast("long")
    v, d, topic = F.col("visit_days"), F.col("last_day") - F.col("first_day"), place_reference(F.col("lat"), F.col("lon"))
    rows = places.withColumn("pos", nth).filter("visit_days > 1")
    return rows.select("owner_id", topic.alias("topic"), (v / (v + 1)).alias("score"), (v / (v + 3) * (d / (d + cfg.span_half_days))).alias("confidence"), (F.col("first_day") * 86400).alias("first_at"), (F.col("last_day") * 86400).alias("last_at"), F.array(topic, topic).alias("evidence"), "pos")


def anchors_in_order(anchors: DataFrame) -> DataFrame:
    """Anchors with ``rank`` by owner: most days first, then in order of founding."""
    return anchors.withColumn("rank", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("visit_days"), "place")))


def profiles_in_order(profiles: DataFrame, most: int | None = None) -> DataFrame:
    """Place profiles with ``rank`` by owner: most visits first, then from south to north and west to east."""
    rows = profiles.withColumn("rank", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("visits"), "lat", "lon")))
    return rows.filter(F.col("rank") <= most) if most else rows


def revisits(profiles: DataFrame, today_us: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Overdue places by owner: last seen more than twice the usual gap ago."""
    days = F.floor((F.lit(today_us) - F.col("last_t")) / DAY_US).cast("int")
    rows = profiles.withColumn("days_since", days).filter((F.col("visits") >= cfg.regular_visits) & ~F.col("only_on_trips") & (F.col("gap_days") > 0))
    rows = rows.filter(F.floor((F.col("last_t") - F.col("first_t")) / DAY_US) >= cfg.regular_span_days).filter(F.col("days_since") > cfg.overdue_factor * F.col("gap_days"))
    return rows.select("owner_id", place_reference(F.col("lat"), F.col("lon")).alias("reference"), "days_since", F.col("gap_days").alias("cadence_days"), F.least(F.lit(1.0), F.col("visits") / cfg.suggestion_full).alias("confidence"), (F.col("days_since") / F.col("gap_days")).alias("ratio"))


def day_trips(profiles: DataFrame, reach: DataFrame, today_us: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Quiet, little-known places within the usual reach, longest unseen first, one per neighbourhood, a few per owner."""
    o = regular_places(profiles, cfg).select("owner_id", F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    km = metres(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) / 1000
    rows = profiles.filter(F.col("visits") <= cfg.day_trip_max_visits).withColumn("days_since", F.floor((F.lit(today_us) - F.col("last_t")) / DAY_US).cast("int")).filter(F.col("days_since") >= cfg.quiet_days)
    rows = rows.join(o, "owner_id").groupBy("owner_id", "place", "lat", "lon", "visits", "days_since").agg(F.min(km).alias("km")).join(reach.select("owner_id", "usual_km"), "owner_id")
    rows = rows.filter((F.col("km") >= cfg.day_trip_min_km) & (F.col("km") <= F.col("usual_km"))).withColumn("reference", place_reference(F.col("lat"), F.col("lon")))

    rows = rows.withColumn("confidence", F.least(F.lit(1.0), F.col("visits") / cfg.suggestion_full))
    order = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("days_since"), "km", "reference"))
    kept = spread_out(rows.withColumn("nth", order).select("owner_id", "nth", "reference", "days_since", "km", "confidence"), cfg)
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("owner_id").orderBy("nth"))).filter(F.col("k") <= cfg.day_trip_cap).drop("nth", "k")


def spread_out(suggestions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Suggestions (owner_id, nth, reference, ...) without those near an earlier kept one of their owner; topics have no neighbourhood and pass.

    Each depends on those kept before it, so an owner's sorted rows pass through one task, which holds the kept places alone.
    """
    ship(suggestions.sparkSession)
    names = suggestions.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, points = None, []
        for batch in batches:
            keep = []
            for o, reference in zip(batch.column("owner_id").to_pylist(), batch.column("reference").to_pylist()):
                if o != owner:
                    owner, points = o, []
                found = _POINT.match(reference or "")
                at = (float(found[1]), float(found[2])) if found else None
                near = at is not None and any(point_metres(*p, *at) < cfg.neighbour_km * 1000 for p in points)
                if at is not None and not near:
                    points.append(at)
                keep.append(not near)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return suggestions.select(*names).repartition("owner_id").sortWithinPartitions("owner_id", "nth").mapInArrow(fold, suggestions.schema)


def density(photos: DataFrame, decimals: int = 2) -> DataFrame:
    """Photographs per rounded coordinate."""
    return photos.filter("lat is not null").groupBy(F.bround("lat", decimals).alias("lat"), F.bround("lon", decimals).alias("lon")).agg(F.count("*").alias("n"))
