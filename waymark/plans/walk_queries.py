"""Queries whose places lie a few hundred metres apart, so that the order-dependent folds can differ; their SQL folds row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.geo import metres_sql
from waymark.operators import change as C
from waymark.operators import journeys as J
from waymark.operators import places as P
from waymark.sources.bindings import table
from waymark.sources.scratch import kept

QUERIES, SQL = {}, {}
MINUTE_US = 60_000_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


WALKS_SQL = f"""nth_order as (select o_custkey as owner_id, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as nth from orders),
walks as (
  select owner_id, 'p' || lpad(cast(k as varchar), 12, '0') as photo_id, 1704067200000000 + ((nth - case when nth % 4 = 3 then 1 else 0 end) * (5 + owner_id % 4 * 10) + case when nth >= 6 then owner_id % 3 * 60 else 0 end) * {MINUTE_US} as t,
         35.0::double + 0.0009::double * (case when owner_id % 2 = 0 then k * 37 % 9 else nth * 2 + k % 3 end) as lat, 135.0::double + 0.0007::double * (k * 11 % 4) as lon from nth_order
)"""


def walks(spark, d):
    """One photograph an order: steps of about 100 metres at random or along a line, at paces around the drift, some at one instant, some after a silence."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("k"), nth.alias("nth"))
    k, n, o = F.col("k"), F.col("nth"), F.col("owner_id")
    minutes = (n - F.when(n % 4 == 3, 1).otherwise(0)) * (5 + o % 4 * 10) + F.when(n >= 6, o % 3 * 60).otherwise(0)
    t = F.lit(1704067200000000) + minutes * MINUTE_US
    lat = F.lit(35.0) + 0.0009 * F.when(o % 2 == 0, k * 37 % 9).otherwise(n * 2 + k % 3)
    return rows.select("owner_id", F.concat(F.lit("p"), F.lpad(k.cast("string"), 12, "0")).alias("photo_id"), t.alias("t"), t.alias("lt"), lat.alias("lat"), (F.lit(135.0) + 0.0007 * (k * 11 % 4)).alias("lon"), F.lit("photo").alias("kind"))


FOLDED_SQL = f"""{WALKS_SQL},
steps as (select *, row_number() over (partition by owner_id order by t, photo_id) as i from walks),
fold as (
  select owner_id, i, photo_id, t, lat, lon, 0 as g, 1 as n, lat as y, lon as x from steps where i = 1
  union all
  select owner_id, i, photo_id, t, lat, lon, case when stays then g else g + 1 end, case when stays then n + 1 else 1 end, case when stays then y + lat else lat end, case when stays then x + lon else lon end
  from (
    select s.owner_id, s.i, s.photo_id, s.t, s.lat, s.lon, f.g, f.n, f.y, f.x,
      s.t - f.t <= 5400000000 and ({metres_sql("f.y / f.n", "f.x / f.n", "s.lat", "s.lon")} <= 300 or (s.t > f.t and {metres_sql("f.lat", "f.lon", "s.lat", "s.lon")} / 1000 / ((s.t - f.t) / 3.6e9) <= 1.5)) as stays
    from fold f join steps s on s.owner_id = f.owner_id and s.i = f.i + 1)
),
wstops as (select owner_id, min(t) as t0, max(t) as t1, avg(lat) as lat, avg(lon) as lon, count(*) as n_photos, min_by(photo_id, i) as stop from fold group by owner_id, g),
wstays as (select *, row_number() over (partition by owner_id order by t0, t1, stop) as i from wstops where t1 - t0 >= 600000000 or n_photos >= 5)"""


@query(f"with recursive {FOLDED_SQL} select owner_id, stop, t0, t1, round(lat + 3.3e-8::double, 6) as lat, round(lon + 3.3e-8::double, 6) as lon, n_photos, t1 - t0 >= 600000000 or n_photos >= 5 as is_stay from wstops")
def walk_stops(spark, d):
    near = lambda c: F.round(F.col(c) + 3.3e-8, 6).alias(c)
    return J.stops(walks(spark, d)).select("owner_id", F.get("photo_ids", F.lit(0)).alias("stop"), "t0", "t1", near("lat"), near("lon"), "n_photos", "is_stay")


def _near_sql(radius: int, source: str) -> str:
    """First place in order of founding whose running centre is near; ``source`` has owner_id, i, stop, lat, lon."""
    return f"""put as (
  select owner_id, i, stop, 0 as place, [{{'n': 1, 'y': lat, 'x': lon}}] as ps from {source} where i = 1
  union all
  select owner_id, i, stop, coalesce(hit, len(ps) + 1) - 1, case when hit is null then list_append(ps, {{'n': 1, 'y': lat, 'x': lon}})
    else list_transform(ps, lambda p, j: case when j = hit then {{'n': p.n + 1, 'y': p.y + lat, 'x': p.x + lon}} else p end) end
  from (
    select s.owner_id, s.i, s.stop, s.lat, s.lon, f.ps, nullif(list_position(list_transform(f.ps, lambda p: {metres_sql("p.y / p.n", "p.x / p.n", "s.lat", "s.lon")} <= {radius}), true), 0) as hit
    from put f join {source} s on s.owner_id = f.owner_id and s.i = f.i + 1)
)"""


def _walk_stays(spark, d):
    return kept(J.stays(walks(spark, d)), "walk-stays")


@query(f"with recursive {FOLDED_SQL}, {_near_sql(150, 'wstays')} select owner_id, stop, cast(place as bigint) as place from put")
def walk_places_150m(spark, d):
    return P.placed(_walk_stays(spark, d), 150.0).select("owner_id", "stop", "place")


# Every photograph of a walk as a stay of its own: more places an owner.
_POINTS_SQL = "spots as (select owner_id, photo_id as stop, lat, lon, t, row_number() over (partition by owner_id order by t, photo_id) as i from walks)"


def _spots(spark, d):
    return walks(spark, d).select("owner_id", F.col("photo_id").alias("stop"), F.col("t").alias("t0"), F.col("t").alias("t1"), F.col("lt").alias("lt0"), F.col("lt").alias("lt1"), "lat", "lon", F.lit(1).cast("long").alias("n_photos"))


@query(f"with recursive {WALKS_SQL}, {_POINTS_SQL}, {_near_sql(150, 'spots')} select owner_id, stop, cast(place as bigint) as place from put")
def walk_spots_150m(spark, d):
    return P.placed(_spots(spark, d), 150.0).select("owner_id", "stop", "place")


@query(f"with recursive {WALKS_SQL}, {_POINTS_SQL}, {_near_sql(500, 'spots')} select owner_id, stop, cast(place as bigint) as place from put")
def walk_spots_500m(spark, d):
    return P.placed(_spots(spark, d), 500.0).select("owner_id", "stop", "place")


_MEAN = lambda c: f"list_sum(list_transform({c}s, lambda v, j: case when pl[j] = cur then v else 0 end)) / len(list_filter(pl, lambda v: v = cur))"


@query(
    f"""with recursive {WALKS_SQL}, {_POINTS_SQL},
    own as (select owner_id, list(stop order by i) as stops, list(lat order by i) as lats, list(lon order by i) as lons from spots group by owner_id),
    grow as (
      select owner_id, stops, lats, lons, list_transform(lats, lambda v, j: case when j = 1 then 0 else -1 end) as pl, 0 as cur from own
      union all
      select owner_id, stops, lats, lons, case when list_contains(near, true) then list_transform(pl, lambda v, j: case when near[j] then cur else v end) else list_transform(pl, lambda v, j: case when j = list_position(pl, -1) then cur + 1 else v end) end,
        case when list_contains(near, true) then cur else cur + 1 end
      from (select *, list_transform(pl, lambda v, j: v = -1 and {metres_sql("cy", "cx", "lats[j]", "lons[j]")} <= 500) as near from (select *, {_MEAN("lat")} as cy, {_MEAN("lon")} as cx from grow where list_contains(pl, -1)))
    ), done as (select * from grow where not list_contains(pl, -1))
    select owner_id, unnest(stops) as stop, cast(unnest(pl) as bigint) as place from done"""
)
def walk_spots_grown(spark, d):
    return P.placed(_spots(spark, d), 500.0, P.grown).select("owner_id", "stop", "place")


@query(
    f"""with recursive cand as (
      select c_nationkey as owner_id, row_number() over (partition by c_nationkey order by c_custkey) as nth, case when c_custkey % 9 = 0 then 'topic-' || c_custkey else printf('place:%.5f,%.5f', 35.0::double + 0.007::double * (c_custkey * 37 % 11), 135.0::double + 0.009::double * (c_custkey * 11 % 5)) end as reference,
        35.0::double + 0.007::double * (c_custkey * 37 % 11) as lat, 135.0::double + 0.009::double * (c_custkey * 11 % 5) as lon, c_custkey % 9 = 0 as topic from customer),
    thin as (
      select owner_id, nth, reference, true as keep, case when topic then [] else [{{'y': lat, 'x': lon}}] end as ps from cand where nth = 1
      union all
      select owner_id, nth, reference, topic or not near, case when topic or near then ps else list_append(ps, {{'y': lat, 'x': lon}}) end
      from (select c.*, f.ps, len(list_filter(f.ps, lambda p: {metres_sql("p.y", "p.x", "c.lat", "c.lon")} < 2000)) > 0 as near from thin f join cand c on c.owner_id = f.owner_id and c.nth = f.nth + 1)
    ) select cast(owner_id as bigint) as owner_id, nth, reference from thin where keep"""
)
def neighbours_thinned(spark, d):
    from pyspark.sql import Window

    c = F.col("c_custkey")
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    place = F.format_string("place:%.5f,%.5f", F.lit(35.0) + 0.007 * (c * 37 % 11), F.lit(135.0) + 0.009 * (c * 11 % 5))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("owner_id"), nth.alias("nth"), F.when(c % 9 == 0, F.concat(F.lit("topic-"), c)).otherwise(place).alias("reference"))
    return P.spread_out(rows)


@query(
    """with i as (select 'topic ' || p_partkey as topic, ['enduring', 'rising', 'new'][p_partkey % 3 + 1] as kind, (p_partkey * 37 % 101) / 101.0::double as magnitude from part)
    select a.topic as held, b.topic as rising, round(a.magnitude * b.magnitude, 9) as product from i a, i b where a.kind = 'enduring' and b.kind = 'rising' order by round(a.magnitude * b.magnitude, 12) desc, held, rising limit 3"""
)
def mixed_pairs_made(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("enduring", "rising", "new"))), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.concat(F.lit("topic "), k).alias("topic"), kind.alias("kind"), (k * 37 % 101 / F.lit(101.0)).alias("magnitude"))
    return C.mixed_pairs(rows).select("held", "rising", F.round("product", 9).alias("product"))
