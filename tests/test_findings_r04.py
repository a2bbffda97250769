"""Faults that the review of round 4 found."""

import math

import pytest


def sql_words(docs, questions, depth):
    """The documents that the SQL finds."""
    import duckdb

    from waymark.plans.reading_queries import words_sql

    con = duckdb.connect()
    con.execute("create table docs(doc_key varchar, text varchar)")
    con.execute("create table asked(query_id bigint, question varchar)")
    con.executemany("insert into docs values (?, ?)", docs)
    con.executemany("insert into asked values (?, ?)", questions)
    return {(q, k): s for q, k, s in con.execute(f"with {words_sql('docs', 'asked', depth)} select query_id, doc_key, score from worded").fetchall()}


@pytest.mark.parametrize("small", [{}, {"QUESTION_BLOCK": 3, "MOST_SCORES": 300}, {"MOST_WORDS": 4, "MOST_ASKED": 2}])
def test_known_questions_find_what_the_sql_finds(spark, monkeypatch, small):
    from tests.test_lexical import made
    from waymark.operators import lexical

    for name, n in small.items():
        monkeypatch.setattr(lexical, name, n)
    docs, questions = made(900, 1)
    docs += [(f"c{i}", docs[0][1]) for i in range(40)]  # copies: by key
    docs += [("d00007", "w0 w1"), ("d00007", docs[7][1]), ("d00008", " ".join(reversed(docs[8][1].split()))), ("d00009", "w2 Ⅷ w2")]  # keys that come twice
    questions += [(9, "w1 THE, w300 w0"), (10, "the w0 w1 w300"), (11, "w0 w0 w0"), (12, "")]  # 1, 9 and 10 ask the same
    d, q = spark.createDataFrame(docs, "doc_key string, text string").repartition(5), spark.createDataFrame(questions, "query_id long, question string")
    for depth in (1, 30):
        got = {(r.query_id, r.doc_key): r.score for r in lexical.match_known(d, q, depth).collect()}
        want = sql_words(docs, questions, depth)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_known_questions_on_empty_tables(spark):
    from waymark.operators import lexical

    none, q = spark.createDataFrame([], "doc_key string, text string"), spark.createDataFrame([(1, "a")], "query_id long, question string")
    assert lexical.match_known(none, q, 3).count() == 0
    assert lexical.match_known(spark.createDataFrame([("k", "a")], none.schema), q.filter("false"), 3).count() == 0
    assert [tuple(r)[:2] for r in lexical.match_known(spark.createDataFrame([("k", "a"), (None, "b"), (None, None)], none.schema), q.selectExpr("cast(query_id as int) as query_id", "question"), 3).collect()] == [(1, "k")]


def test_no_posting_of_known_questions_is_a_row(spark, sf, monkeypatch):
    from waymark.operators import lexical
    from waymark.plans import reading_queries

    rows = {}
    monkeypatch.setattr(lexical, "kept", lambda df, name, f=lexical.kept: rows.setdefault(name, []).append(f(df, name)) or rows[name][-1])
    found = reading_queries.match_words_all(spark, sf).count()
    texts = reading_queries.table(spark, sf, "documents")
    assert found > 0 and "lexical-postings" not in rows and rows["lexical-rows"][0].count() == texts.count()
    parts = rows["lexical-rows"][0].rdd.getNumPartitions()
    asked = rows["lexical-weights"][0].select("lead").distinct().count()
    assert max(r.count() for r in rows["lexical-found"]) <= parts * 30 * asked  # of each task and question the best


def test_words_are_what_the_pattern_finds():
    import re
    import unicodedata

    from waymark.operators import lexical

    every = "".join(chr(c) for c in range(0x3000) if not chr(c).isupper())
    spaced = "".join(c if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" or c == "_" else " " for c in every)
    assert [w.decode() for w in lexical._cut(every)] == re.findall("[^ ]+", spaced)


def test_what_is_found_is_worked_out_once(spark, monkeypatch):
    from waymark.operators import asking

    rows = [(1, "a", 0.03, 1), (1, "b", 0.02, 2), (2, "b", 0.03, 1)]
    seen = spark.sparkContext.accumulator(0)

    def pass_on(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    kind = "query_id long, doc_key string, score double, nth int"
    found = spark.createDataFrame(rows, kind).mapInPandas(pass_on, kind)
    docs = spark.createDataFrame([("a", 5, "x topic 1"), ("b", 7, "topic 3"), ("c", 9, "y")], "doc_key string, t long, text string")
    asked = spark.createDataFrame([(1, "topic 2"), (2, None), (3, "topic 3")], "query_id long, question string")
    insights = spark.createDataFrame([(f"topic {i}", i) for i in range(1, 5)], "topic string, rank long")
    monkeypatch.setattr(asking, "TOPIC_BLOCK", 2)
    got = asking.ask(found, asked, docs, spark.createDataFrame([], "reference string"), insights)
    answers = {r.query_id: (r.n, r.first_seen, r.last_seen, r.evidence, r.supporting) for r in got.collect()}
    assert answers == {1: (2, 5, 7, ["a", "b"], ["topic 1", "topic 2", "topic 3"]), 2: (1, 7, 7, ["b"], ["topic 3"]), 3: (0, None, None, [], [])}
    assert seen.value == len(rows)


def test_equal_questions_are_searched_once(spark, sf, monkeypatch):
    from waymark.operators import lexical
    from waymark.operators import retrieval as R
    from waymark.plans import asking_queries

    rows = {}
    monkeypatch.setattr(lexical, "kept", lambda df, name, f=lexical.kept: rows.setdefault(name, []).append(f(df, name)) or rows[name][-1])
    docs = spark.createDataFrame([(f"k{i:02d}", f"a b{i} c{i % 3}") for i in range(50)], "doc_key string, text string").coalesce(1)
    asked = spark.createDataFrame([(i, f"a c{i % 3}") for i in range(60)], "query_id long, question string")
    assert lexical.match_known(docs, asked, 4).count() == 240
    assert sum(r.count() for r in rows["lexical-found"]) == 12  # of three questions
    depths = []
    monkeypatch.setattr(R, "dense_all", lambda v, q, depth, f=R.dense_all: depths.append(depth) or f(v, q, depth))
    asking_queries._filtered(spark, sf)
    assert sorted(depths) == [30, 300]  # the deeper one for questions with a place
