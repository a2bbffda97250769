"""Places of owners of any size: regions fold apart and give the places and numbers of one fold over all stays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import journeys, places

HOUR = 3_600_000_000


def scattered(seed):
    """Stays (owner, stop, t, lat, lon) in towns, along lines, near a pole and on both sides of the date line; owner 0 has most."""
    rng, out = random.Random(seed), []
    towns = [(35 + rng.uniform(-3, 3), 135 + rng.uniform(-3, 3)) for _ in range(40)]
    for i in range(1500):
        owner = 0 if rng.random() < 0.9 else rng.randint(1, 3)
        kind = rng.random()
        if kind < 0.7:
            y, x = rng.choice(towns)
            y, x = y + rng.gauss(0, 0.004), x + rng.gauss(0, 0.004)
        elif kind < 0.85:
            y, x = 36.0, 134 + rng.randint(0, 600) * 0.0012
        elif kind < 0.93:
            y, x = -17 + rng.gauss(0, 0.003), rng.choice([179.9995, -179.9995]) + rng.gauss(0, 0.0001)
        else:
            y, x = 86 + rng.gauss(0, 0.003), rng.uniform(-180, 180)
        out.append((owner, f"s{i:05d}", i * HOUR, y, x))
    return out


def stays_of(spark, rows):
    df = spark.createDataFrame(rows, "owner_id long, stop string, t0 long, lat double, lon double")
    return df.selectExpr("owner_id", "stop", "t0", "t0 + 600000000 as t1", "t0 as lt0", "t0 + 600000000 as lt1", "lat", "lon", "3L as n_photos")


@pytest.mark.parametrize("how, radius", [(places.first_near, 150.0), (places.first_near, 500.0), (places.grown, 500.0)])
def test_regions_change_no_place(spark, how, radius):
    rows = scattered(int(radius))
    got = {r.stop: r.place for r in places.placed(stays_of(spark, rows), radius, how).collect()}
    for owner in range(4):
        own = sorted((r for r in rows if r[0] == owner), key=lambda r: r[2])
        want = how(np.array([r[3] for r in own]), np.array([r[4] for r in own]), radius)
        assert [got[r[1]] for r in own] == want.tolist()


def test_one_owner_lands_in_many_regions(spark):
    rows = scattered(9)
    per = places.regions(stays_of(spark, rows), 150.0).groupBy("owner_id").agg(F.countDistinct("region").alias("regions"), F.max("lat").alias("m"))
    assert {r.owner_id: r.regions for r in per.collect()}[0] > 25
    biggest = places.regions(stays_of(spark, rows), 150.0).filter("owner_id = 0").groupBy("region").count().agg(F.max("count")).first()[0]
    assert biggest < 400


def test_outings_carry_over_days(spark):
    rng = random.Random(4)
    times = sorted(rng.sample(range(0, 24 * 60), 300))
    rows = [(i % 2, f"s{i}", t * HOUR // 4, 35.0, 135.0) for i, t in enumerate(times)]
    df = stays_of(spark, rows)
    got = {r.stop: r.outing for r in journeys.numbered_stops(df).collect()}
    for owner in range(2):
        n, end = 0, None
        for o, stop, t0, *_ in sorted((r for r in rows if r[0] == owner), key=lambda r: r[2]):
            n += end is None or t0 - end > 8 * HOUR
            end = t0 + 600_000_000
            assert got[stop] == n
