"""Faults that the review of round 3 found."""

import json

from pyspark.sql import functions as F


def test_interests_are_ordered_by_what_is_told_of_them(spark):
    from waymark.operators import evidence as E
    from waymark.operators import payloads as Y

    rows = [("b", 0.5000000004, 0.4), ("a", 0.5, 0.4), ("c", 0.7, 0.9)]  # equal to nine decimals: by topic
    profile = spark.createDataFrame([(*r, 0, 0, ["x"]) for r in rows], "topic string, score double, confidence double, first_at long, last_at long, evidence array<string>")
    none = spark.createDataFrame([], "rank long, topic string, stage string")
    told = json.loads(Y.export_document(profile, none, "2024-02-01").first()["payload"])
    assert [i["topic"] for i in told["interests"]] == ["c", "a", "b"]
    assert [r.topic for r in E.subject_facts(profile).orderBy("nth").collect()] == ["c", "a", "b"]


def test_waves_of_a_long_run_are_few_and_whole(spark, tmp_path):
    from waymark.operators import stages

    rows = spark.range(200).select(F.format_string("k%03d", "id").alias("key"), F.col("id").cast("string").alias("request"), F.lit(None).cast("string").alias("why"), F.col("id").alias("t"))
    looked = stages._selection(rows, spark.createDataFrame([], "key string"), F.asc("t"))
    got = stages.run(looked, lambda texts: [(f"said {t}", None) for t in texts], str(tmp_path / "s"), "v1", wave=2, batch=1)
    assert got == stages.Report(200, 0, 0, 0, 0, False)
    assert len(list((tmp_path / "s").glob("wave=*"))) <= stages.WAVES
    assert {(r.key, r.text) for r in stages.results(spark, str(tmp_path / "s")).collect()} == {(f"k{i:03d}", f"said {i}") for i in range(200)}


def test_an_index_for_known_questions_holds_their_words_and_gives_the_same(spark, monkeypatch):
    from tests.test_lexical import made
    from waymark.operators import lexical

    docs, questions = made(300, 4)
    d, q = spark.createDataFrame(docs, "doc_key string, text string"), spark.createDataFrame(questions, "query_id long, question string")
    rows = lambda index: sorted(tuple(r) for r in lexical.match_words(index, q, 8).select("query_id", "doc_key", "score").collect())
    whole = lexical.build_index(d)
    want, terms = rows(whole), {r.term for r in lexical.question_terms(q).collect()}
    for most in (50_000, 2):  # handed to tasks, and joined
        monkeypatch.setattr(lexical, "MOST_ASKED", most)
        index = lexical.build_index(d, questions=q)
        assert rows(index) == want and index.docs == whole.docs
        assert {r.term for r in index.blocks.select("term").distinct().collect()} <= terms


def test_copies_tie_in_whatever_order_their_parts_come(spark, monkeypatch):
    from waymark.operators import lexical

    parts = [0.1, 0.7, 0.2, 1e-3 / 3]
    rows = [(1, "a", p) for p in parts] + [(1, "b", p) for p in reversed(parts)] + [(1, "c", p) for p in (parts[2], parts[0], parts[3], parts[1])]
    monkeypatch.setattr(lexical, "parts", lambda *_: spark.createDataFrame(rows, "query_id long, doc_key string, part double").coalesce(1))
    monkeypatch.setattr(lexical.F, "round", lambda c, n: c)
    got = lexical.match_words(None, spark.createDataFrame([(1, "x")], "query_id long, question string"), 3).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1


def test_bm25_reads_texts_once(spark):
    from waymark.operators import retrieval as R

    docs = spark.createDataFrame([("a", "the idiot the"), ("b", "Trash."), ("c", "nothing"), ("d", "")], "doc_key string, text string")
    got = R.bm25(docs, ["idiot", "the", "trash"])
    assert {r.doc_key for r in got.collect()} == {"a", "b"}
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()  # what is read twice is the kept counts


def test_texts_of_stays_are_shuffled_once(spark):
    from waymark.operators import retrieval as R

    p = spark.createDataFrame([("p", 5, None), ("q", 3, None), ("r", 9, None)], "photo_id string, t long, preference boolean")
    c = spark.createDataFrame([("k", ["p", "q"], "one"), ("k", ["r"], "one"), ("k", ["r"], "two"), ("m", ["gone"], "three"), ("n", ["p"], None)], "key string, photo_ids array<string>, text string")
    none = spark.createDataFrame([], "photo_id string, text string, category string")
    got = R.gather(c, none, none, p)
    assert sorted((r.doc_key, r.text, r.t) for r in got.collect()) == [("stay:k", "one", 3), ("stay:k", "two", 9)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [key#" in plan and not any("Aggregate" in x and "text#" in x.split("], [")[0] for x in plan.splitlines())  # no group is told apart by its text


def test_questions_and_documents_are_cut_alike(spark):
    from waymark.operators import lexical

    odd = "Henry \u2167 a\u203fb x\u200dy na\u0303o \u0663 \u00b2 c_d"  # a Roman numeral, a tie, a joiner, a mark, digits
    d, q = spark.createDataFrame([("k", odd)], "doc_key string, text string"), spark.createDataFrame([(1, odd)], "query_id long, question string")
    asked = {r.term for r in lexical.question_terms(q).collect()}
    assert asked == {r.term for r in lexical.build_index(d).blocks.select("term").collect()} == {"henry", "a", "b", "x", "y", "na\u0303o", "\u0663", "c_d"}


def test_sessions_are_cut_without_sorting_photographs(spark):
    from waymark.operators import journeys as J

    times = {0: [0, 5399, 5400, 10800, 16201, 16202], 1: [5399, 10799, 16199, 21600], 2: [-5401, -1, 0, 5401, 3 * 86400]}
    rows = [(o, f"{o}-{i}", t * 1_000_000) for o, ts in times.items() for i, t in enumerate(ts)] + [(None, "x", 1), (3, "y", None)]
    cut = J.gap_sessions(spark.createDataFrame(rows, "owner_id long, photo_id string, t long"))
    want = {}
    for o, ts in times.items():
        for i, t in enumerate(ts):
            begins = not i or t - ts[i - 1] > 5400
            want[f"{o}-{i}"] = t * 1_000_000 if begins else want[f"{o}-{i - 1}"]
    assert {r.photo_id: r.session for r in cut.collect()} == want
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert not any("photo_id" in line for line in plan.splitlines() if "Window" in line)


def test_what_two_parts_of_suggestions_read_is_made_once(spark, sf, monkeypatch):
    from waymark.plans import journey_queries, reading_queries, stage_queries

    asked = []
    for module, name in ((journey_queries, "years"), (reading_queries, "history")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name: asked.append(n) or f(*a))
    stage_queries.suggestions_annotated(spark, sf)
    assert sorted(asked) == ["history", "years"]
    assert "events.parquet" not in reading_queries.lifecycle(spark, sf)._jdf.queryExecution().toString()  # snapshots are read from what is kept
