"""Clashing names, nulls, empties, repeated rows and ids of other types for every operator; hot grams and threshold pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import byte_bpe, chat, decontaminate, language_id, line_dedup, near_dedup, quality_rules, sharding, suffix_dedup, toxicity
from waymark.llm.common import shared_dir
from waymark.llm.queries import tokenizer_path, tokenizer_pattern

#: Names that operators use inside or give to results.
NAMES = (
    "text_in", "n_words", "n_hit", "items", "spans", "lang_pred", "score", "ambiguous", "segments", "k0", "k1", "h", "h1", "h2", "t", "len", "at", "d", "d_key", "h_key", "cut_spans", "cut", "n_lines", "n_removed", "n_spans",
    "shard", "slot", "size", "digest", "block", "nth", "law", "text_crc32", "grown_shard", "n_bytes", "kept", "kept_sha256", "ids", "decoded", "offsets", "n_tokens", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "c", "c1", "c2", "v", "n", "rep", "root", "component_id", "kept_id", "text_key", "item", "win", "k", "tid", "g",
)
TEXTS = ["one two three four five six seven eight", "one two three four five six seven eight", None, "", "   ", "a\nb\nc\na\nb\nc", "x " * 4000, "vile scum here", "!?"]


@pytest.fixture(scope="module")
def wide(spark):
    cols = [f"'own {n}' as `{n}`" for n in NAMES]
    rows = spark.createDataFrame([(i, t, "xx" if i % 2 else "yy") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "yy"), (None, "no id", None)], "doc_id long, text string, lang string")
    return rows.selectExpr("*", *cols).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (7, 0, 1), (None, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    bench = spark.createDataFrame([(1, "three four five"), (None, "six seven"), (2, None), (3, "!")], "item_id long, text string")
    every = lambda f: lambda df: f(df, df.columns)
    return {
        "scan": lambda df: decontaminate.scan(df, bench, keep=df.columns), "joined": lambda df: decontaminate.scan(df, bench, keep=df.columns, max_words=0),
        "predict": lambda df: language_id.predict(df, language_id.fit(df)), "score": lambda df: toxicity.score(df, toxicity.fit(df, labels)), "encode": lambda df: byte_bpe.encode(df, tokenizer_path(), tokenizer_pattern(), with_offsets=True),
        "lines": line_dedup.dedup_lines, "stats": every(lambda df, k: quality_rules.text_stats(df, k)), "rules": every(lambda df, k: quality_rules.apply(df, labels, k)[0]),
        "shards": every(lambda df, k: sharding.shard_by_bytes(df, 3, keep=k)), "suffix": every(lambda df, k: suffix_dedup.suffix_dedup(df, k, with_text=True)),
    }


@pytest.mark.parametrize("name", ["scan", "joined", "predict", "score", "encode", "lines", "stats", "rules", "shards", "suffix"])
def test_no_name_clashes_and_no_row_is_lost(spark, wide, labels, name):
    run = operators(spark, labels)[name]
    got = run(wide)
    assert got.columns[: len(wide.columns)] == wide.columns and len({c.lower() for c in got.columns}) == len(got.columns)
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)
    assert run(wide.limit(0)).count() == 0


def test_dropping_and_cutting_keep_the_columns(spark, wide, labels):
    bench = spark.createDataFrame([(1, "three four five")], "item_id long, text string")
    for got in (decontaminate.drop_contaminated(wide, bench), decontaminate.cut_spans(wide, bench), corpus_pipeline.dedup_lines(spark, wide, ""), corpus_pipeline.dedup_near(spark, wide, "")):
        assert got.columns == wide.columns and got.count() > 0


def test_items_without_an_id_count_as_one_null(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b"), (None, "c d"), (5, "b c")], "item_id long, text string")
    for most in (10**6, 0):
        r = decontaminate.scan(docs, bench, n=2, max_words=most).first()
        assert (r.n_hit, r["items"]) == (4, ["5", None])


def test_near_dedup_and_toxicity_of_text_ids(spark, labels):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None), (None, "other words than these are here")], "doc_id string, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True)}
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 4


def test_a_table_of_many_languages_is_refused(spark):
    docs = spark.range(600).select(F.col("id").cast("string").alias("lang"), F.lit("text").alias("text"))
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs)


def test_repeated_nodes_of_a_tree_count_once(spark):
    one = [(1, i, i - 1 if i else None, "user", f"m{i}", 0.0) for i in range(6)]
    schema = "tree long, node long, parent long, role string, text string, score double"
    want = [r.formatted for r in chat.format_paths(spark.createDataFrame(one, schema)).collect()]
    more = one + one + [(1, 3, 2, "user", "z later", 0.0), (1, None, 2, "user", "lost", 0.0)]
    assert [r.formatted for r in chat.format_paths(spark.createDataFrame(more, schema)).collect()] == want


def test_a_shared_folder_is_demanded_off_local_masters():
    class Fake:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Fake(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def counted(texts, length=400):
    """Removed bytes by text, by counting the hashes of all strings."""
    n = Counter(hash(b[i : i + length]) for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if n[hash(b[i : i + length])] > 1:
                gone[i] += 1
                gone[min(len(b), i + length)] -= 1
        out.append(int((np.cumsum(gone)[:-1] > 0).sum()))
    return out


def test_one_gram_with_more_contexts_than_a_task_sorts(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    core, edges = word(240), [word(170) for _ in range(40)]
    texts = [word(100) + core + word(100) for _ in range(20_400)] + [r.choice(edges) + core + r.choice(edges) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x.doc_id: x.n_removed for x in suffix_dedup.suffix_dedup(df).collect()}
    assert [got[i] for i in range(len(texts))] == counted([t.encode() for t in texts]) and sum(got.values()) > 0


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity just at 85 percent, in sets larger than a sketch: none may be missed."""
    r, made, want = random.Random(9), [], 0
    for p in range(3000):
        a = [f"w{r.getrandbits(40)}" for _ in range(104 + p % 50)]
        size = len(a) - 4
        changed = next(k for k in range(1, size) if 100 * (size - k) < 85 * (size + k)) - 1  # shingles that may differ
        b = a[: len(a) - changed] + [f"w{r.getrandbits(40)}" for _ in range(changed)]
        made += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
        want += 1
    got = near_dedup.near_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(8)).filter("not kept").collect()
    assert len(got) == want and all(x.component_id == x.doc_id - 1 for x in got)
