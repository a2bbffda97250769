"""Registered queries do the whole job: whole texts, every question, every anchor, the production thresholds."""

import os

import duckdb
import pytest

from waymark.operators import evidence as E
from waymark.operators import places as P
from waymark.operators import retrieval as R
from waymark.plans.registry import queries, sql


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_index_documents_hold_whole_texts(spark, sf, con):
    got = rows(queries()["index_documents"](spark, sf), "doc_key", "kind", "text", "t")
    whole = sql()["index_documents"]
    assert "substr(" not in whole
    assert got == sorted(con.sql(f"select doc_key, kind, text, t from ({whole})").fetchall())
    assert max(len(r[2]) for r in got) > 1000


def test_every_hundredth_vector_is_a_query(spark, sf, con):
    got = queries()["match_meaning_all"](spark, sf).groupBy("query_id").count().collect()
    assert sorted(map(tuple, got)) == [(i, 30) for (i,) in con.sql("select vec_id from embeddings where vec_id % 100 = 0 order by 1").fetchall()]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_dense_all_with_ties_widths_and_nulls(spark, monkeypatch, block):
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    monkeypatch.setattr(R, "ROW_BLOCK", block)
    made = [(f"d{i:02d}", [float(i % 4), float(i % 3)]) for i in range(40)] + [("wide", [9.0, 9.0, 9.0]), ("none", None), ("hole", [9.0, None]), ("empty", [])]
    asked = [(1, [1.0, 0.5]), (2, [0.0, -1.0]), (3, [1.0, 1.0, 1.0]), (4, [2.0])]
    got = rows(R.dense_all(spark.createDataFrame(made, "doc_key string, embedding array<float>").repartition(3), spark.createDataFrame(asked, "query_id long, embedding array<float>"), 7), "query_id", "doc_key", "score")
    want = []
    for q, v in asked:
        all_of = [(-sum(a * b for a, b in zip(v, e)), k) for k, e in made if e and None not in e and len(e) == len(v)]
        want += [(q, k, -s) for s, k in sorted(all_of)[:7]]
    assert got == sorted(want)


# Production has every anchor, 2 visits and 30 days, and so has the SQL; an earlier one fitted tables of 30 days.
PRODUCTION = [("anchored_exclusion_antijoin", "a.visit_days >= 20 and ", ""), ("day_trips", "visits <= 1000", "visits <= 2"), ("suggest_revisit", "86400000000 >= 20", "86400000000 >= 30")]


@pytest.mark.parametrize("name,tuned,whole", PRODUCTION)
def test_production_thresholds(spark, sf, con, name, tuned, whole):
    assert tuned not in sql()[name] and whole in sql()[name]
    df = queries()[name](spark, sf)
    want = con.sql(f"select {', '.join(df.columns)} from ({sql()[name]})").fetchall()
    assert rows(df, *df.columns) == [pytest.approx(r) for r in sorted(want)]


def test_places_inside_an_anchor_of_five_days_are_no_interests(spark):
    day, s = 86_400_000_000, []
    for owner, days in ((1, 5), (2, 4)):
        s += [(owner, i * day, i * day + 1, i * day, i * day + 1, 35.0, 135.0, 3) for i in range(days)]
        s += [(owner, i * day + 2, i * day + 3, i * day + 2, i * day + 3, 35.1, 135.0, 3) for i in range(2)]
    df = spark.createDataFrame(s, "owner_id long, t0 long, t1 long, lt0 long, lt1 long, lat double, lon double, n_photos long")
    got = rows(P.outside_anchors(P.visit_days(P.placed(df, 500.0)), P.anchors(df)), "owner_id", "lat", "visit_days")
    assert [(o, round(y, 3), n) for o, y, n in got] == [(1, 35.1, 2), (2, 35.0, 4), (2, 35.1, 2)]


def test_little_known_places_and_regular_spans(spark):
    day = 86_400_000_000
    cols = "owner_id long, place long, lat double, lon double, visits long, first_t long, last_t long, gap_days int, only_on_trips boolean"
    made = [(1, 1, 35.0, 135.0, 9, 0, 40 * day, 4, False), (1, 2, 35.05, 135.0, 2, 0, 9 * day, 9, False), (1, 3, 35.1, 135.0, 3, 0, 29 * day, 9, False), (1, 4, 35.15, 135.0, 3, 0, 30 * day, 9, False)]
    df = spark.createDataFrame(made, cols)
    reach = spark.createDataFrame([(1, 50.0)], "owner_id long, usual_km double")
    assert rows(P.day_trips(df, reach, 400 * day), "reference") == [("place:35.05000,135.00000",)]
    assert rows(P.revisits(df, 400 * day), "reference") == [("place:35.00000,135.00000",), ("place:35.15000,135.00000",)]


def test_numbered_facts_are_whole_texts_of_the_results(spark):
    made = [("a", "stay", "long  text\n" * 400, 0), ("b", "screen", "short", 86_400_000_000), ("c", "single", "latest, not found", 900 * 86_400_000_000)]
    docs = spark.createDataFrame(made, "doc_key string, kind string, text string, t long")
    got = E.numbered_facts(docs, spark.createDataFrame([("b", 0.1), ("a", 0.2)], "doc_key string, score double")).first()
    assert (got.n, got.facts) == (2, f"[F1] (1970-01-01, stay) {made[0][2]}\n[F2] (1970-01-02, screen) short")


def test_registered_facts_keep_whole_texts(spark, sf, con):
    got = queries()["numbered_facts"](spark, sf).first()
    whole = sql()["index_documents"]
    assert "substr(" not in whole
    texts = [t for (t,) in con.sql(f"select distinct text from ({whole}) where length(text) > 90").fetchall()]
    assert got.n >= 8 and any(t in got.facts for t in texts)


def test_eight_subjects_become_facts(spark, sf, con):
    assert "nth <= 8" in sql()["subject_facts"]
    want = con.sql(f"select topic, fact from ({sql()['subject_facts']})").fetchall()
    assert rows(queries()["subject_facts"](spark, sf), "topic", "fact") == sorted(want) and len(want) == 8
