"""Queries over photographs, journeys, measures and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import metres_sql, nearest_within
from waymark.operators import journeys as J
from waymark.operators import measures as M
from waymark.operators import places as P
from waymark.sources.bindings import PHOTOS_SQL, YEARS_SQL, YEARS_TODAY, photos, table, years
from waymark.sources.scratch import kept

QUERIES, SQL = {}, {}
US = 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STOPS_SQL = f"""{PHOTOS_SQL},
located as (select * from photos where coalesce(kind, 'photo') = 'photo' and lat is not null),
marked as (select *, case when t - lag(t) over w <= {5400 * US} and cell = lag(cell) over w then 0 else 1 end as new from located window w as (partition by owner_id order by t, photo_id)),
counted as (select *, sum(new) over (partition by owner_id order by t, photo_id rows unbounded preceding) as g from marked),
groups as (
  select owner_id, min(t) as t0, max(t) as t1, min(lt) as lt0, max(lt) as lt1, avg(lat) as lat, avg(lon) as lon, any_value(cell) as place,
         count(*) as n_photos, list(photo_id) as ids from counted group by owner_id, g
),
stays as (select * from groups where t1 - t0 >= {600 * US} or n_photos >= 5),
ostart as (select *, case when t0 - lag(t1) over (partition by owner_id order by t0) <= {28800 * US} then 0 else 1 end as new from stays),
numbered as (select * exclude (new), cast(sum(new) over (partition by owner_id order by t0 rows unbounded preceding) as bigint) as outing from ostart),
legs as (select *, {metres_sql("lat", "lon", "lead(lat) over w", "lead(lon) over w")} as leg from numbered window w as (partition by owner_id, outing order by t0)),
outings as (
  select owner_id, outing, min(t0) as t0, max(t1) as t1, min(lt0) as lt0, max(lt1) as lt1, count(*) as n_stops, cast(sum(n_photos) as bigint) as n_photos,
         coalesce(sum(leg), 0) / 1000 as km, substr(sha256(array_to_string(list_sort(flatten(list(ids))), '|')), 1, 16) as outing_id from legs group by owner_id, outing
),
visits as (
  select owner_id, place, avg(lat) as lat, avg(lon) as lon, count(distinct lt0 // 86400000000) as visit_days, min(lt0 // 86400000000) as first_day,
         max(lt0 // 86400000000) as last_day, cast(sum(n_photos) as bigint) as n_photos from stays group by owner_id, place
),
gaps as (select *, lt0 // 86400000000 - lag(lt0 // 86400000000) over (partition by owner_id, place order by t0) as gap from stays),
profiles as (
  select owner_id, place, avg(lat) as lat, avg(lon) as lon, count(*) as visits, min(t0) as first_t, max(t0) as last_t, cast(round_even(median(gap), 0) as int) as gap_days
  from gaps group by owner_id, place
),
home as (
  select * from (select *, max(visits >= 3 and (last_t - first_t) // 86400000000 >= 30) over (partition by owner_id) as has_home,
                        row_number() over (partition by owner_id order by visits desc, first_t) as nth from profiles)
  where (visits >= 3 and (last_t - first_t) // 86400000000 >= 30) or (not has_home and nth = 1)
)"""


def _stays(spark: SparkSession, d: str) -> DataFrame:
    """Stays, folded once for all parts of a query."""
    return kept(J.stays(photos(spark, d)), "stays")


def _year_stays(spark: SparkSession, d: str) -> DataFrame:
    """Stays of the library over the years."""
    return kept(J.stays(years(spark, d)), "year-stays")


def on_years(sql: str) -> str:
    """SQL over the photographs, over those of the years instead."""
    assert PHOTOS_SQL in sql
    return sql.replace(PHOTOS_SQL, YEARS_SQL, 1)


def _deg(c):
    """Rounded away from the halves that means of rounded coordinates hit."""
    return F.round(F.col(c) + 3.3e-8, 6).alias(c)


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query(f"with {PHOTOS_SQL} select owner_id, coalesce(kind, 'photo') = 'photo' as joins_journeys, coalesce(preference, true) as may_inform, count(*) as n from photos group by all")
def observations(spark, d):
    p = photos(spark, d)
    return p.groupBy("owner_id", (F.col("kind").isNull() | (F.col("kind") == "photo")).alias("joins_journeys"), F.coalesce("preference", F.lit(True)).alias("may_inform")).agg(F.count("*").alias("n"))


@query(f"with {PHOTOS_SQL} select owner_id, count(lat) as located, count(*) - count(lat) as unlocated from photos where coalesce(kind, 'photo') = 'photo' group by owner_id")
def unlocated_split(spark, d):
    p = photos(spark, d).filter(F.col("kind").isNull() | (F.col("kind") == "photo"))
    return p.groupBy("owner_id").agg(F.count("lat").alias("located"), (F.count("*") - F.count("lat")).alias("unlocated"))


@query(
    f"""with {PHOTOS_SQL}, located as (select * from photos where coalesce(kind, 'photo') = 'photo' and lat is not null),
    m as (select *, case when t - lag(t) over w <= {5400 * US} then 0 else 1 end as new from located window w as (partition by owner_id order by t, photo_id)),
    s as (select *, sum(new) over (partition by owner_id order by t, photo_id rows unbounded preceding) as g from m)
    select owner_id, min(t) as session, max(t) as ended, count(*) as n from s group by owner_id, g"""
)
def gap_sessions(spark, d):
    rows = J.gap_sessions(J.located(photos(spark, d)))
    return rows.groupBy("owner_id", "session").agg(F.max("t").alias("ended"), F.count("*").alias("n"))


@query(f"with {STOPS_SQL} select owner_id, t0, t1, lt0, lt1, round(lat + 3.3e-8::double, 6) as lat, round(lon + 3.3e-8::double, 6) as lon, n_photos, t1 - t0 >= {600 * US} or n_photos >= 5 as is_stay from groups")
def stop_extraction(spark, d):
    return J.stops(photos(spark, d)).select("owner_id", "t0", "t1", "lt0", "lt1", _deg("lat"), _deg("lon"), "n_photos", "is_stay")


@query(f"with {STOPS_SQL} select owner_id, count(*) filter (t1 - t0 >= {600 * US} or n_photos >= 5) as stays, cast(coalesce(sum(n_photos) filter (t1 - t0 < {600 * US} and n_photos < 5), 0) as bigint) as in_transit from groups group by owner_id")
def stay_filter(spark, d):
    s = J.stops(photos(spark, d))
    return s.groupBy("owner_id").agg(F.count_if("is_stay").alias("stays"), F.coalesce(F.sum(F.when(~F.col("is_stay"), F.col("n_photos"))), F.lit(0)).alias("in_transit"))


@query(f"with {STOPS_SQL} select owner_id, outing_id, t0, t1, n_stops, n_photos from outings")
def outing_assembly(spark, d):
    return J.outings(J.numbered_stops(_stays(spark, d))).select("owner_id", "outing_id", "t0", "t1", "n_stops", "n_photos")


@query(f"with {STOPS_SQL} select owner_id, outing_id, round(km, 6) as km, round((t1 - t0) / 3.6e9, 6) as hours from outings")
def outing_travel(spark, d):
    return J.outings(J.numbered_stops(_stays(spark, d))).select("owner_id", "outing_id", _r("km").alias("km"), _r((F.col("t1") - F.col("t0")) / 3.6e9).alias("hours"))


@query(
    f"""with {STOPS_SQL}, v as (
      select owner_id, unnest(['travel_km', 'duration_h', 'stops', 'photos']) as measure, unnest([km, (t1 - t0) / 3.6e9, n_stops, n_photos]) as value from outings
      union all select owner_id, 'stay_min', (t1 - t0) / 6e7 from stays)
    select owner_id, measure, count(*) as n, round(min(value), 6) as least, round(median(value), 6) as median, round(avg(value), 6) as mean, round(max(value), 6) as most from v group by owner_id, measure"""
)
def spread_habits(spark, d):
    s = _stays(spark, d)
    o = J.outings(J.numbered_stops(s))
    a = M.spread(o, ["owner_id"], {"travel_km": F.col("km"), "duration_h": (F.col("t1") - F.col("t0")) / 3.6e9, "stops": F.col("n_stops"), "photos": F.col("n_photos")})
    b = M.spread(s, ["owner_id"], {"stay_min": (F.col("t1") - F.col("t0")) / 6e7})
    return a.unionByName(b).select("owner_id", "measure", "n", *(_r(c).alias(c) for c in ("least", "median", "mean", "most")))


@query(
    f"""with {STOPS_SQL}, slots as (select owner_id, slot from (select distinct owner_id from outings), (select unnest(range(0, 7)) as slot))
    select slots.owner_id, cast(slot as int) as weekday, count(o.t0) as n from slots left join outings o on o.owner_id = slots.owner_id and (o.lt0 // 86400000000 + 3) % 7 = slot group by all"""
)
def rhythm_weekday(spark, d):
    o = J.outings(J.numbered_stops(_stays(spark, d)))
    return M.histogram(o, "owner_id", M.wall_weekday(F.col("lt0")), 7).withColumnRenamed("slot", "weekday")


@query(
    f"""with {STOPS_SQL}, slots as (select owner_id, slot from (select distinct owner_id from outings), (select unnest(range(0, 24)) as slot))
    select slots.owner_id, cast(slot as int) as hour, count(o.t0) as n from slots left join outings o on o.owner_id = slots.owner_id and (o.lt0 // 3600000000) % 24 = slot group by all"""
)
def rhythm_hour(spark, d):
    o = J.outings(J.numbered_stops(_stays(spark, d)))
    return M.histogram(o, "owner_id", M.wall_hour(F.col("lt0")), 24).withColumnRenamed("slot", "hour")


@query(
    f"""with {STOPS_SQL} select owner_id, count(*) as n_outings, round(avg(((lt0 // 86400000000 + 3) % 7 >= 5)::int), 9) as weekend_share,
    round(avg(((lt0 // 3600000000) % 24 < 9)::int), 9) as early_share from outings group by owner_id"""
)
def rhythm_shares(spark, d):
    o = J.outings(J.numbered_stops(_stays(spark, d)))
    return o.groupBy("owner_id").agg(F.count("*").alias("n_outings"), _r(F.avg((M.wall_weekday(F.col("lt0")) >= 5).cast("int")), 9).alias("weekend_share"), _r(F.avg((M.wall_hour(F.col("lt0")) < 9).cast("int")), 9).alias("early_share"))


_MONTHLY = """counts as (select {s} as series, cast(date_trunc('month', {at}) as date) as month, count(*) as n from {t} group by all),
span as (select series, min(month) as a, max(month) as b from counts group by series),
months as (select series, cast(unnest(generate_series(a, b, interval 1 month)) as date) as month from span),
monthly as (select m.series, m.month, coalesce(n, 0) as n from months m left join counts c on c.series = m.series and c.month = m.month)"""
ORDERS_SQL, LINES_SQL = _MONTHLY.format(s="o_orderpriority", at="o_orderdate", t="orders"), _MONTHLY.format(s="l_returnflag || l_linestatus", at="l_shipdate", t="lineitem")


def _order_months(spark, d):
    return M.monthly(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"))


def _line_months(spark, d):
    return M.monthly(table(spark, d, "lineitem"), F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"))


@query(f"with {ORDERS_SQL} select series, strftime(month, '%Y-%m') as month, n from monthly")
def monthly_counts_zero_filled(spark, d):
    return _order_months(spark, d).select("series", F.date_format("month", "yyyy-MM").alias("month"), "n")


@query(
    f"""with {ORDERS_SQL}, p as (select a.series as "left", b.series as "right", count(*) as months, covar_pop(a.n, b.n) as cov, stddev_pop(a.n) as sa, stddev_pop(b.n) as sb
      from monthly a join monthly b on a.month = b.month and a.series < b.series group by all),
    q as (select *, case when months >= 4 and sa > 0 and sb > 0 then cov / (sa * sb) else 0 end as al from p)
    select "left", "right", months, case when months < 4 then 'unknown' when al >= 0.6 then 'co-occurring' when al <= -0.6 then 'divergent' else 'unrelated' end as relation, round(al, 6) as alignment from q"""
)
def alignment_pearson(spark, d):
    return M.alignment(_order_months(spark, d)).select("left", "right", "months", "relation", _r("alignment").alias("alignment"))


@query(
    f"""with {LINES_SQL}, r as (select *, row_number() over (partition by series order by month desc) as back, count(*) over (partition by series) as months from monthly),
    e as (select *, back <= least(3, months // 2) as recent from r where months >= 4),
    b as (select series, months, avg(n) filter (not recent) as baseline, stddev_pop(n) filter (not recent) as sigma, max(n) filter (back = 1) as latest from e group by series, months),
    f as (select b.*, bool_and(abs(e.n - baseline) >= 1.5 * sigma) as far from b join e on e.series = b.series and e.recent group by all)
    select series, months, case when sigma = 0 then case when latest = baseline then 'baseline' else 'new pattern' end when abs(latest - baseline) < 1.5 * sigma then 'baseline'
      when far then 'persistent' when abs(latest - baseline) >= 3 * sigma then 'new pattern' else 'gradual' end as stage, cast(latest as double) as latest, round(baseline, 6) as baseline from f"""
)
def drift_stage(spark, d):
    return M.drift(_line_months(spark, d)).withColumn("baseline", _r("baseline"))


@query(
    f"""with {STOPS_SQL}, q as (select owner_id, km, row_number() over (partition by owner_id order by km) - 1 as i, count(*) over (partition by owner_id) as n from outings where n_stops > 1)
    select owner_id, count(*) as n_outings, round(max(km) filter (i = round_even((n - 1) * 0.5, 0)), 6) as typical_km, round(max(km) filter (i = round_even((n - 1) * 0.8, 0)), 6) as usual_km from q group by owner_id"""
)
def reach_quantile(spark, d):
    return M.reach(J.outings(J.numbered_stops(_stays(spark, d)))).select("owner_id", "n_outings", _r("typical_km").alias("typical_km"), _r("usual_km").alias("usual_km"))


_PLACE_COLS = "owner_id, round(lat + 3.3e-8::double, 6) as lat, round(lon + 3.3e-8::double, 6) as lon"


def _at():
    return ["owner_id", _deg("lat"), _deg("lon")]


@query(f"with {STOPS_SQL} select {_PLACE_COLS}, visits from profiles")
def place_cluster_150m(spark, d):
    return P.place_profiles(P.placed(_stays(spark, d), 150.0)).select(*_at(), "visits")


@query(f"with {STOPS_SQL} select {_PLACE_COLS}, visit_days, n_photos from visits")
def place_cluster_500m(spark, d):
    return P.visit_days(P.placed(_stays(spark, d), 500.0)).select(*_at(), "visit_days", "n_photos")


_HOURS = "(lt{0} // 3600000000) % 24"
_NIGHT = " or ".join(f"({_HOURS.format(i)} >= 20 or {_HOURS.format(i)} <= 6)" for i in (0, 1))
_WORK = " or ".join(f"({_HOURS.format(i)} between 10 and 17)" for i in (0, 1))
ANCHORS_SQL = f"""{STOPS_SQL},
anchors as (
  select owner_id, place, avg(lat) as lat, avg(lon) as lon, count(distinct lt0 // 86400000000) as visit_days, count(distinct lt0 // 86400000000) filter ({_NIGHT}) as night_days,
         count(distinct lt0 // 86400000000) filter ({_WORK}) as daytime_days, count(distinct lt0 // 86400000000) filter ((lt0 // 86400000000 + 3) % 7 < 5) as weekday_days,
         min(t0) as t0, max(t1) as t1, cast(sum(n_photos) as bigint) as n_photos from stays group by owner_id, place having count(distinct lt0 // 86400000000) >= 5
)"""


@query(f"with {ANCHORS_SQL} select {_PLACE_COLS}, visit_days, night_days, daytime_days, weekday_days, t0, t1, n_photos, round(least(1.0, visit_days / 20.0), 9) as confidence, 500.0::double as radius_m from anchors")
def anchor_day_shares(spark, d):
    return P.anchors(_stays(spark, d)).select(*_at(), "visit_days", "night_days", "daytime_days", "weekday_days", "t0", "t1", "n_photos", _r("confidence", 9).alias("confidence"), "radius_m")


@query(f"with {STOPS_SQL} select owner_id, count(*) as n_places, round(avg((visit_days > 1)::int), 9) as return_rate, round(avg((visit_days = 1)::int), 9) as one_time_rate from visits group by owner_id")
def place_return_rates(spark, d):
    r = P.return_rates(P.visit_days(P.placed(_stays(spark, d), 500.0)))
    return r.select("owner_id", "n_places", _r("return_rate", 9).alias("return_rate"), _r("one_time_rate", 9).alias("one_time_rate"))


@query(f"with {STOPS_SQL} select {_PLACE_COLS}, visits, first_t, last_t, gap_days from profiles")
def place_gap_median(spark, d):
    return P.place_profiles(P.placed(_stays(spark, d), 150.0)).select(*_at(), "visits", "first_t", "last_t", "gap_days")


_INTEREST = "round(visit_days / (visit_days + 1.0), 9) as score, round(visit_days / (visit_days + 3.0) * ((last_day - first_day) / (last_day - first_day + 30.0)), 9) as confidence, first_day, last_day"


@query(f"with {STOPS_SQL} select owner_id, printf('place:%.5f,%.5f', lat, lon) as topic, {_INTEREST} from visits where visit_days > 1")
def place_interest_score(spark, d):
    r = P.place_interests(P.visit_days(P.placed(_stays(spark, d), 500.0)))
    return r.withColumns({"score": _r("score", 9), "confidence": _r("confidence", 9)})


@query(f"with {on_years(ANCHORS_SQL)} select {_PLACE_COLS}, visit_days from visits v where not exists (select 1 from anchors a where a.owner_id = v.owner_id and {metres_sql('a.lat', 'a.lon', 'v.lat', 'v.lon')} <= 500)")
def anchored_exclusion_antijoin(spark, d):
    s = _year_stays(spark, d)
    return P.outside_anchors(P.visit_days(P.placed(s, 500.0)), P.anchors(s)).select(*_at(), "visit_days")


NAMES_SQL = "names as (select n_name as label, 34.0 + (n_nationkey * 37 % 25) * 0.1::double as lat, 134.2 + (n_nationkey * 11 % 23) * 0.1::double as lon from nation)"


def _names(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_name").alias("label"), (F.lit(34.0) + (k * 37 % 25) * 0.1).alias("lat"), (F.lit(134.2) + (k * 11 % 23) * 0.1).alias("lon"))


@query(
    f"""with {STOPS_SQL}, {NAMES_SQL}, p as (select owner_id || ':' || t0 as key, lat, lon from stays),
    h as (select key, names.label, {metres_sql("p.lat", "p.lon", "names.lat", "names.lon")} as m from p, names),
    b as (select key, label, m, row_number() over (partition by key order by m, label) as k from h where m <= 25000)
    select p.key, b.label, round(b.m, 3) as distance_m from p left join b on b.key = p.key and b.k = 1"""
)
def nearest_gazetteer(spark, d):
    p = _stays(spark, d).select(F.concat_ws(":", "owner_id", "t0").alias("key"), "lat", "lon")
    return nearest_within(p, _names(spark, d), 25_000.0).select("key", "label", _r("distance_m", 3).alias("distance_m"))


@query(f"with {STOPS_SQL} select s.owner_id, s.t0, round(min({metres_sql('h.lat', 'h.lon', 's.lat', 's.lon')}), 3) as home_m from stays s join home h on h.owner_id = s.owner_id group by all")
def nearest_origin(spark, d):
    s = _stays(spark, d)
    o = P.regular_places(P.place_profiles(P.placed(s, 150.0)))
    return J.nearest_origin(s, o).select("owner_id", "t0", _r("home_m", 3).alias("home_m"))


TRIPS_SQL = f"""{STOPS_SQL},
dist as (select n.owner_id, n.outing, n.t0, n.t1, n.lt0, n.lt1, min({metres_sql("h.lat", "h.lon", "n.lat", "n.lon")}) as m from numbered n join home h on h.owner_id = n.owner_id group by all),
per as (select owner_id, outing, min(m) >= 50000 as away, max(m) as most, min(t0) as t0, max(t1) as t1, min(lt0) as lt0, max(lt1) as lt1 from dist group by owner_id, outing),
runs as (select *, case when away and lag(away) over w and t0 - lag(t1) over w <= {129600 * US} then 0 else 1 end as new from per window w as (partition by owner_id order by t0)),
run as (select *, sum(new) over (partition by owner_id order by t0 rows unbounded preceding) as r from runs),
trips as (
  select owner_id, min(t0) as t0, max(t1) as t1, count(*) as n_outings, max(most) / 1000 as km, list(outing) as outings, max(lt1) // 86400000000 - min(lt0) // 86400000000 as nights
  from run where away group by owner_id, r having max(lt1) // 86400000000 - min(lt0) // 86400000000 >= 1
)"""


def _trips(spark, d, stays=_stays):
    s = stays(spark, d)
    placed = kept(P.placed(s, 150.0), "placed")
    profiles, numbered = P.place_profiles(placed), J.numbered_stops(s)
    return J.trips(numbered, P.regular_places(profiles)), numbered, placed, profiles


@query(f"with {TRIPS_SQL} select owner_id, t0, t1, n_outings, round(km, 6) as farthest_km, nights from trips")
def trip_runs(spark, d):
    return _trips(spark, d)[0].select("owner_id", "t0", "t1", "n_outings", _r("farthest_km").alias("farthest_km"), "nights")


TRIP_PROFILES_SQL = f"""{TRIPS_SQL}, on_trip as (select owner_id, unnest(outings) as outing from trips),
tv as (select n.owner_id, n.place, count(*) as k from numbered n join on_trip o on o.owner_id = n.owner_id and o.outing = n.outing group by all),
tp as (select p.*, coalesce(k, 0) as trip_visits from profiles p left join tv on tv.owner_id = p.owner_id and tv.place = p.place)"""


@query(f"with {TRIP_PROFILES_SQL} select {_PLACE_COLS}, visits, trip_visits, trip_visits = visits as only_on_trips from tp")
def place_trip_visits(spark, d):
    trips, numbered, placed, profiles = _trips(spark, d)
    return P.with_trip_visits(profiles, placed, trips, numbered).select(*_at(), "visits", "trip_visits", "only_on_trips")


@query(
    f"""with {on_years(TRIP_PROFILES_SQL)}, s as (select *, ({YEARS_TODAY} - last_t) // 86400000000 as days from tp)
    select owner_id, printf('place:%.5f,%.5f', lat, lon) as reference, cast(days as int) as days_since, gap_days as cadence_days, round(least(1.0, visits / 6.0), 9) as confidence, round(days / gap_days, 6) as ratio
    from s where visits >= 3 and trip_visits <> visits and gap_days > 0 and (last_t - first_t) // 86400000000 >= 30 and days > 2 * gap_days"""
)
def suggest_revisit(spark, d):
    trips, numbered, placed, profiles = _trips(spark, d, _year_stays)
    r = P.revisits(P.with_trip_visits(profiles, placed, trips, numbered), YEARS_TODAY)
    return r.withColumns({"confidence": _r("confidence", 9), "ratio": _r("ratio")})


@query(
    f"""with {on_years(STOPS_SQL)}, q as (select owner_id, km, row_number() over (partition by owner_id order by km) - 1 as i, count(*) over (partition by owner_id) as n from outings where n_stops > 1),
    reach as (select owner_id, max(km) filter (i = round_even((n - 1) * 0.8, 0)) as usual from q group by owner_id),
    c as (select p.owner_id, p.place, printf('place:%.5f,%.5f', p.lat, p.lon) as reference, cast(({YEARS_TODAY} - p.last_t) // 86400000000 as int) as days_since, p.visits, min({metres_sql("h.lat", "h.lon", "p.lat", "p.lon")}) / 1000 as km
      from profiles p join home h on h.owner_id = p.owner_id group by all),
    k as (select c.*, row_number() over (partition by c.owner_id order by days_since desc, km, reference) as nth from c join reach r on r.owner_id = c.owner_id where days_since >= 180 and visits <= 2 and km >= 1 and km <= usual)
    select owner_id, reference, days_since, round(km, 6) as km, round(least(1.0, visits / 6.0), 9) as confidence from k where nth <= 3"""
)
def day_trips(spark, d):
    s = _year_stays(spark, d)
    r = P.day_trips(P.place_profiles(P.placed(s, 150.0)), M.reach(J.outings(J.numbered_stops(s))), YEARS_TODAY)
    return r.withColumns({"km": _r("km"), "confidence": _r("confidence", 9)})


@query(f"with {PHOTOS_SQL} select round_even(lat, 2) as lat, round_even(lon, 2) as lon, count(*) as n from photos where lat is not null group by 1, 2")
def density_grid(spark, d):
    return P.density(photos(spark, d))


@query(
    f"""with {PHOTOS_SQL} select count(*) as photographs, count(*) filter (lat is null) as unlocated, count(*) filter (kind = 'screenshot') as screenshots,
    count(*) filter (not coalesce(preference, true)) as withheld, count(distinct owner_id) as owners from photos"""
)
def privacy_counts(spark, d):
    p = photos(spark, d)
    return p.agg(F.count("*").alias("photographs"), F.count_if(F.col("lat").isNull()).alias("unlocated"), F.count_if(F.col("kind") == "screenshot").alias("screenshots"), F.count_if(~F.coalesce("preference", F.lit(True))).alias("withheld"), F.countDistinct("owner_id").alias("owners"))


@query(
    f"""with {STOPS_SQL}, r as (select *, row_number() over (partition by owner_id order by visit_days desc, n_photos desc, first_day, lat) as k from visits)
    select {_PLACE_COLS}, visit_days, n_photos from r where k <= 5 and visit_days > 1"""
)
def top_returned_places(spark, d):
    v = P.visit_days(P.placed(_stays(spark, d), 500.0))
    w = Window.partitionBy("owner_id").orderBy(F.desc("visit_days"), F.desc("n_photos"), "first_day", "lat")
    return v.withColumn("k", F.row_number().over(w)).filter("k <= 5 and visit_days > 1").select(*_at(), "visit_days", "n_photos")
