"""Keyword search by each question's words: equal to plain BM25, with fewer postings scored than there are."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from waymark.operators import lexical


def plain(docs, questions, depth):
    words = {k: Counter(re.findall(r"\w+", (t or "").lower())) for k, t in docs}
    size = {k: sum(c.values()) for k, c in words.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in words.values() for w in c)
    out = {}
    for q, text in questions:
        scores = {}
        for w in re.findall(r"\w+", (text or "").lower()):
            for k, c in words.items():
                if c[w]:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[k] = scores.get(k, 0.0) + idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[k] / mean))
        best = sorted(((-round(s, 12), k) for k, s in scores.items()))[:depth]
        out.update({(q, k): -s for s, k in best})
    return out


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(f"d{i:05d}", " ".join(["the", *rng.choices(vocabulary, weights, k=rng.randint(1, 40))])) for i in range(n)]
    docs += [("e0", None), ("e1", ""), ("e2", "Ünï Ünï 日本 の-w1"), ("f1", docs[0][1]), ("f2", docs[0][1])]
    questions = [(1, "the w0 w1 w300"), (2, "w17 the the"), (3, docs[0][1]), (4, "nowhere"), (5, None), (6, "ünï, 日本!"), (7, "THE"), (8, "w2 w2 w3 w399 w200")]
    return docs, questions


def test_equals_plain_scores_at_every_depth(spark):
    docs, questions = made(900, 1)
    d, q = spark.createDataFrame(docs, "doc_key string, text string"), spark.createDataFrame(questions, "query_id long, question string")
    index = lexical.build_index(d)
    again = lexical.open_index(spark, index.path)
    for depth in (1, 8, 30, 300):
        got = {(r.query_id, r.doc_key): r.score for r in lexical.match_words(again, q, depth).collect()}
        want = plain(docs, questions, depth)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert index.blocks.agg(F.max("n")).first()[0] == lexical.BLOCK


def test_bounds_leave_postings_out(spark):
    docs, questions = made(4000, 2)
    d, q = spark.createDataFrame(docs, "doc_key string, text string"), spark.createDataFrame(questions[:1] + questions[-1:], "query_id long, question string")
    index, asked = lexical.build_index(d), lexical.question_terms(q)
    all_rows = index.blocks.join(asked, "term").agg(F.sum("n")).first()[0]
    scored = lexical.parts(index, asked, 8).count()
    assert 0 < scored < 0.6 * all_rows
    got = {(r.query_id, r.doc_key) for r in lexical.match_words(index, q, 8).collect()}
    assert got == plain(docs, questions[:1] + questions[-1:], 8).keys()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_key string, text string")
    index = lexical.build_index(none)
    assert lexical.match_words(index, spark.createDataFrame([(1, "a")], "query_id long, question string"), 3).count() == 0


def test_topics_in_texts(spark, monkeypatch):
    from waymark.operators import asking

    rng = random.Random(6)
    topics = [(f"topic {i} {'Ünïcode' if i % 9 == 0 else ''}".strip(), i + 1) for i in range(400)] + [("TOPIC 7", 401), ("opic", 402), ("zz", 403)]
    texts = [(i, " and ".join(f"topic {rng.randrange(2000)}" for _ in range(rng.randint(0, 6))).lower()) for i in range(60)] + [(99, None), (98, "zz topic 9 ünïcode")]
    told, found = spark.createDataFrame(texts, "query_id long, told string"), spark.createDataFrame(topics, "topic string, rank long")
    want = {q: [t for t, r in topics if t.lower() in (s or "")][:3] for q, s in texts}
    for block in (50_000, 37):
        monkeypatch.setattr(asking, "TOPIC_BLOCK", block)
        got = {r.query_id: r.supporting for r in asking.supporting(told, found).collect()}
        assert got == {q: t for q, t in want.items() if t}
    assert "CartesianProduct" not in asking.supporting(told, found)._jdf.queryExecution().toString()


def test_very_many_topics(spark):
    from waymark.operators import asking

    found = spark.range(100_000).select(F.concat(F.lit("word"), "id").alias("topic"), (F.col("id") + 1).alias("rank"))
    told = spark.createDataFrame([(i, f"word{i * 997} x word99999") for i in range(100)], "query_id long, told string")
    got = {r.query_id: r.supporting for r in asking.supporting(told, found).collect()}
    assert len(got) == 100 and all("word99999"[: len(t)] == t or f"word{q * 997}".startswith(t) for q, ts in got.items() for t in ts)
