"""Every query of the engine proper against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from waymark.plans.registry import queries, sql


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def key(row):
    return tuple((x is None, f"{x:.6f}" if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(sql()))
def test_query_equals_sql(name, spark, sf, con):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    rel = con.sql(sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql()[name]})").fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (a, b)


def test_every_query_has_sql():
    assert set(queries()) - set(sql()) == {"match_meaning_cells"}  # its recall is held against the exact way


def test_no_query_is_empty_on_the_middle_tables():
    """Production thresholds leave rows everywhere, so that equality with SQL says something."""
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    d = "/root/testdata/sf0.01"
    for f in os.listdir(d):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    assert [n for n, s in sorted(sql().items()) if not c.execute(f"select count(*) from ({s})").fetchone()[0]] == []
