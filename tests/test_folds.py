"""The order-dependent kernels against single-pass checkers, and the properties that let Spark split them."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.config import DEFAULT
from waymark.operators import journeys as J
from waymark.operators import measures as M
from waymark.operators import places as P

S = 1_000_000


def rows_of(spec):
    return [(f"p{i:03d}", 1, t * S, (t + 9 * 3600) * S, lat, lon, "photo") for i, (t, lat, lon) in enumerate(spec)]


def photos(spark, rows):
    return spark.createDataFrame(rows, "photo_id string, owner_id long, t long, lt long, lat double, lon double, kind string")


def test_gap_of_exactly_the_limit_stays_together(spark):
    rows = J.gap_sessions(photos(spark, rows_of([(0, 35.0, 135.0), (5400, 35.0, 135.0), (10801, 35.0, 135.0)])))
    assert [r.session for r in rows.orderBy("t").collect()] == [0, 0, 10801 * S]


def test_sessions_cross_midnight(spark):
    day = 86400
    rows = J.gap_sessions(photos(spark, rows_of([(day - 600, 35.0, 135.0), (day + 600, 35.0, 135.0), (2 * day + 7200, 35.0, 135.0)])))
    assert [r.session for r in rows.orderBy("t").collect()] == [(day - 600) * S, (day - 600) * S, (2 * day + 7200) * S]


def test_short_burst_of_five_is_a_stay_and_four_is_transit(spark):
    spec = [(i, 35.0, 135.0) for i in range(5)] + [(20000 + i, 36.0, 135.0) for i in range(4)]
    got = {r.n_photos: r.is_stay for r in J.stops(photos(spark, rows_of(spec))).collect()}
    assert got == {5: True, 4: False}


def test_screenshots_and_unlocated_stay_out(spark):
    rows = rows_of([(0, 35.0, 135.0)])
    rows += [("x", 1, 0, 0, None, None, None), ("y", 1, 0, 0, 35.0, 135.0, "screenshot"), ("z", 1, 0, 0, 35.0, 135.0, None)]
    assert sorted(r.photo_id for r in J.located(photos(spark, rows)).collect()) == ["p000", "z"]


def test_drift_keeps_a_slow_walk_together():
    t = np.arange(8) * 1200 * S  # 400 m every 20 minutes is 1.2 km/h
    lat = 35.0 + np.arange(8) * 400 / 111195.0
    assert len(set(J.stop_groups(t, lat, np.full(8, 135.0)))) == 1


def test_one_instant_has_no_pace():
    assert list(J.stop_groups(np.zeros(2), np.array([35.0, 36.0]), np.array([135.0, 135.0]))) == [0, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 3)), min_size=1, max_size=25))
def test_cutting_at_gaps_changes_no_group(points):
    t = np.cumsum([p[0] * 60 for p in points]) * S
    lat = 35.0 + np.array([p[1] for p in points]) * 0.01
    whole = J.stop_groups(t, lat, np.full(len(t), 135.0))
    cut, parts, base = [0, *[i for i in range(1, len(t)) if t[i] - t[i - 1] > DEFAULT.max_gap_s * S], len(t)], [], 0
    for a, b in zip(cut, cut[1:]):
        g = J.stop_groups(t[a:b], lat[a:b], np.full(b - a, 135.0))
        parts += list(g + base)
        base += g.max() + 1
    assert list(whole) == parts


def test_first_near_takes_the_oldest_place_not_the_nearest():
    lat = np.array([35.0, 35.006, 35.0031])
    assert list(P.first_near(lat, np.full(3, 135.0), 500.0)) == [0, 1, 0]


def test_grown_passes_reach_on():
    lat = np.array([35.0, 35.004, 35.0062, 36.0])
    assert list(P.grown(lat, np.full(4, 135.0), 500.0)) == [0, 0, 0, 1]


def test_hours_may_pass_midnight(spark):
    got = spark.range(24).select(M.in_hours(F.col("id"), (20, 6)).alias("x")).collect()
    assert [i for i, r in enumerate(got) if r.x] == [0, 1, 2, 3, 4, 5, 6, 20, 21, 22, 23]


def test_median_gap_rounds_half_even(spark):
    day = 86400 * S
    rows = [(1, 0, t * day, t * day, t * day, t * day, 35.0, 135.0, 5) for t in (0, 2, 5)]
    df = spark.createDataFrame(rows, "owner_id long, place long, t0 long, t1 long, lt0 long, lt1 long, lat double, lon double, n_photos long")
    assert P.place_profiles(df).first().gap_days == 2  # gaps 2 and 3


def test_flat_series_align_to_zero(spark):
    rows = [(s, f"2024-0{m}-01", n) for m in range(1, 6) for s, n in (("a", 3), ("b", m))]
    df = spark.createDataFrame(rows, "series string, month string, n long")
    assert M.alignment(df).first().alignment == 0.0


def plain_grown(lat, lon, radius):
    out = [None] * len(lat)
    place = 0
    for first in range(len(lat)):
        if out[first] is not None:
            continue
        out[first], more = place, [first]
        while more:
            mine = [i for i in range(len(lat)) if out[i] == place]
            y, x = np.mean(lat[mine]), np.mean(lon[mine])
            more = [i for i in range(len(lat)) if out[i] is None and P.point_metres(y, x, lat[i], lon[i]) <= radius]
            for i in more:
                out[i] = place
        place += 1
    return out


def test_grown_by_cells_equals_all_stays():
    made = np.random.default_rng(3)
    for lat, lon in ((35.0, 139.0), (-60.0, 10.0), (84.99, 0.0), (10.0, 179.99)):
        y, x = np.round(lat + made.normal(0, 0.01, 120), 4), (np.round(lon + made.normal(0, 0.01, 120), 4) + 180) % 360 - 180
        assert P.grown(y, x, 500.0).tolist() == plain_grown(y, x, 500.0)
    assert P.grown(np.zeros(0), np.zeros(0), 500.0).tolist() == []
