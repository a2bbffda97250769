"""The pipeline and the registered queries."""

import corpus_pipeline
from tests.llm import brute
from waymark.llm import queries
from waymark.llm.common import stage, table


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    cols, bench = docs.columns, [tuple(r) for r in table(spark, sf, "benchmark").collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf), "test")
        assert docs.columns == cols, name
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert got and all(n == c for n, _, c in [(d, 0, c) for d, _, c in brute.near_dedup(got, corpus_pipeline.ALIKE)])
    assert not any(h for _, _, h, _ in brute.decontaminate(got, bench))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(got) and all(r.decoded == (r.text or "") for r in last)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(k.split("_")[0][2:]) for k in queries.QUERIES) == list(range(1, 14))


def test_near_copies_under_repeated_ids_go(spark, sf):
    alpha, copy = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"word{i}" for i in range(40))
    made = [(1, alpha, 0), (1, copy, 1), (0, copy, 2), (None, copy, 3), (2, "", 4), (2, "", 5), (3, alpha + " end", 6), (None, None, 7)]
    rows = spark.createDataFrame([(i, t, "xx", "s", len(t or ""), k) for i, t, k in made], "doc_id long, text string, lang string, source string, n_chars long, row_id int")
    got = sorted(r.row_id for r in corpus_pipeline.dedup_near(spark, rows, sf).collect())
    assert got == [0, 2, 4, 5, 7]  # the copy of the smallest id, the first of a near pair, and all texts without words


def test_a_run_leaves_its_result_alone(spark, sf):
    from waymark.llm.common import kept_so_far

    before = kept_so_far()
    assert corpus_pipeline.run(spark, sf).count() > 0 and kept_so_far() == before + 1
