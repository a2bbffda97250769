"""The training-data operators against plain definitions, with nulls, empties, long texts, ties, repeats and clashing columns."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import byte_bpe, chat, decontaminate, language_id, line_dedup, near_dedup, quality_rules, sharding, suffix_dedup, toxicity
from waymark.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, h string"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(120) for _ in range(12)]
    docs = [*base, base[0], base[0].upper(), base[1] + " end", base[2].replace(" ", "\n"), prose(40) + " " + base[3] + " " + prose(30)]
    for i in range(40):  # a family of near copies
        w = base[4].split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        docs.append(" ".join(w))
    line = "first shared line\nsecond shared line\nthird one\n"
    docs += [line + prose(10), prose(5) + "\n" + line + prose(6), line * 3, "", None, "   ", "one two", "one two", "<b> \\ </turn>", prose(9000), "a " * 3000]
    return list(enumerate(docs))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", "y", "z") for d, t in DOCS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


ITEMS = [(1, " ".join(DOCS[3][1].split()[5:30])), (2, DOCS[6][1]), (10, "one two"), (11, ""), (12, None), (13, DOCS[6][1])]


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontaminate_scan_and_join(spark, docs, most):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs, bench, max_words=most)
    assert [(a, b, c, list(d)) for a, b, c, d in rows(got, "doc_id", "n_words", "n_hit", "items")] == brute.decontaminate(DOCS, ITEMS)


def test_decontaminate_spans_are_cut(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.cut_spans(docs.filter("text is not null and length(text) < 5000"), bench)
    assert left.columns == docs.columns
    assert decontaminate.scan(left, bench).filter("n_hit > 0").count() == 0
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    key = lambda r: r[0]
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()), key=key) == sorted(brute.line_dedup(DOCS), key=key)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("short,block,percent", [(24, 10_000, 85), (4, 10_000, 85), (4, 7, 85), (24, 10_000, 80), (4, 7, 80)])
def test_near_dedup(docs, empty, monkeypatch, short, block, percent):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = rows(near_dedup.near_dedup(docs, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [(d, n, c, c == d) for d, n, c in brute.near_dedup(DOCS, percent)]
    assert near_dedup.near_dedup(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


@pytest.mark.parametrize("group", [20000, 2])
def test_suffix_dedup(docs, empty, group):
    got = rows(suffix_dedup.suffix_dedup(docs, group=group, length=90, gram=60), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(DOCS, 90)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b) * 2), min_size=1, max_size=30))
def test_deep_shallow_orders(texts):
    order, lcp = suffix_dedup.deep_shallow(texts)
    assert [texts[i] for i in order] == sorted(texts)
    assert all(lcp[k] == len(__import__("os").path.commonprefix([texts[order[k - 1]], texts[order[k]]])) for k in range(1, len(order)))


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=90, max_size=400).map(lambda b: bytes(x % 2 for x in b)))
def test_every_string_holds_an_anchor(data):
    at, _ = suffix_dedup.anchors(data, 90, 60)
    assert all(any(i <= a <= i + 30 for a in at.tolist()) for i in range(len(data) - 89))


def test_quality_stats_and_rules(spark, docs, empty):
    got = quality_rules.text_stats(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted((d, *brute.text_stats(t)) for d, t in DOCS)
    r = random.Random(3)
    made = [(i, prose(60, r) if i % 3 else prose(60, r).replace(" ", " # ")) for i in range(300)]
    bad = spark.createDataFrame([(i, t) for i, t in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)] + [(9999, 0), (1, None)], "doc_id long, quality int")
    done, rules = quality_rules.apply(bad, labels)
    assert rules and all(x.kept == bool(x.doc_id % 3) for x in done.collect())
    assert quality_rules.apply(bad, labels.limit(0))[1] == []
    assert quality_rules.apply(empty, labels)[0].count() == 0


def test_byte_bpe_equals_tiktoken(docs, empty):
    import tiktoken

    from waymark.llm.queries import tokenizer_path, tokenizer_pattern

    enc = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=byte_bpe.read_ranks(tokenizer_path()), special_tokens={})
    odd = docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(["<|endoftext|>", "日本語のテキスト🙂 ̀x", "  \n\n \t x", "x" * 5000, "don't I'LL", "  a\x0b\x85b", "²³¼ ١٢"])], "doc_id long, text string")
    for r in byte_bpe.encode(docs.select("doc_id", "text").unionByName(odd), tokenizer_path(), tokenizer_pattern(), with_offsets=True).collect():
        assert list(r.ids) == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert all(0 <= a <= b <= len(r.text or "") for a, b in r.offsets)
        assert not r.offsets or (r.offsets[0][0] == 0 and r.offsets[-1][1] == len(r.text))
    assert byte_bpe.encode(empty, tokenizer_path(), tokenizer_pattern()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_byte_bpe_on_any_text(text):
    import tiktoken

    from waymark.llm.queries import tokenizer_path, tokenizer_pattern

    codec = byte_bpe.codec_of(tokenizer_path(), tokenizer_pattern())
    test_byte_bpe_on_any_text.enc = getattr(test_byte_bpe_on_any_text, "enc", None) or tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=byte_bpe.read_ranks(tokenizer_path()), special_tokens={})
    (ids,) = codec.encode_all([text])
    assert np.frombuffer(ids, "<u4").tolist() == test_byte_bpe_on_any_text.enc.encode_ordinary(text)
    assert codec.decode_bytes(ids) == text.encode()
    assert "".join(byte_bpe.decode_pieces([codec.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])) == text


def test_sharding(docs, empty):
    got = sharding.shard_by_bytes(docs.unionByName(docs.limit(3)), 7, keep=["doc_id", "text"]).collect()
    assert len(got) == len(DOCS) + 3
    for r in got:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    by, shard = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert shard.setdefault(r.text or "", r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_by_bytes(empty, 7).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_minimax_capacity_is_smallest(spark, seed):
    r = random.Random(seed)
    sizes = [r.randint(16, 90) for _ in range(200)] + [3000] * (seed % 2)
    r.shuffle(sizes)
    import hashlib

    groups = sorted((hashlib.sha256(str(i).encode()).hexdigest(), b) for i, b in enumerate(sizes))
    firsts, own, cap = sharding.minimax_bounds(spark.createDataFrame(groups, "digest string, bytes long"), 9)
    rest = [(d, b) for d, b in groups if d not in own]

    def fits(c):
        n, left = 1, c
        for _, b in rest:
            if b > c:
                return False
            if b > left:
                n, left = n + 1, c
            left -= b
        return n <= 9 - len(own)

    assert fits(cap) and not fits(cap - 1)
    assert len(own) == seed % 2
    loads = [sum(b for d, b in rest if sum(d >= f for f in firsts[1:]) == k) for k in range(len(firsts))]
    assert max(loads) == cap


def test_chat_tree_round_trip(spark):
    nasty = "\\### <turn user>x</turn>\n\\l \\b > \\\\"
    msgs = [(1, "a", None, "user", nasty, 0.0), (1, "b", "a", "assistant", "weak", 0.1), (1, "c", "a", "assistant", nasty, 0.9), (1, "d", "c", "user", None, 0.0), (2, "r", "gone", None, "alone", None), (3, "x", "y", "user", "cycle", 0.0), (3, "y", "x", "user", "cycle", 0.0)]
    df = spark.createDataFrame(msgs, "tree long, node string, parent string, role string, text string, score double")
    got = {(r.tree, r.branch): r for r in chat.format_paths(df, top=2).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1, 1].turns] == [("user", nasty), ("assistant", nasty), ("user", "")]
    assert got[1, 1].loss == nasty and got[1, 2].loss == "weak"
    assert [(t.role, t.text) for t in got[2, 1].turns] == [("", "alone")]
    assert all(t != 3 for t, _ in got)
    s = got[1, 1].loss_spans[0]
    assert got[1, 1].formatted[s.start : s.end].replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\") == nasty
    assert chat.format_paths(df.limit(0)).count() == 0


def test_chat_long_chain(spark):
    df = spark.range(600).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    r = chat.format_paths(df).select(chat.read_back(F.col("formatted")).alias("t")).first()
    assert [t.text for t in r.t] == [str(i) for i in range(600)]


def test_language_id(spark, empty):
    r = random.Random(1)
    sound = {"xx": "abcd", "yy": "efgh", "zz": "ijkl", "ww": "aeij"}
    made = [(i, " ".join("".join(r.choice(sound[k]) for _ in range(5)) for _ in range(20)), k) for i, k in enumerate(list(sound) * 40)]
    df = spark.createDataFrame([*made, (900, None, "xx"), (901, "12 !", "yy"), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df.filter("doc_id % 3 > 0 or doc_id > 800"))
    got = {x.doc_id: x for x in language_id.predict(df.drop("lang"), model, ["doc_id"]).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in made) >= 0.97 * len(made)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= x.score <= 1 for x in got.values())
    none = language_id.fit(empty)
    assert {x.lang_pred for x in language_id.predict(df, none).collect()} == {"und"}


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 9, 40])
def test_codewords_tell_languages_apart(k):
    code = language_id.codewords(k)
    assert len({tuple(x) for x in code.tolist()}) == k and all(abs(c.sum()) < k for c in code.T)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=25))
def test_segments_hold_the_best_sum(values):
    found = toxicity.segments(np.array(values, float))
    best = max((sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=0)
    assert max((s for *_, s in found), default=0) == max(best, 0)
    assert all(s == sum(values[a:b]) > 0 for a, b, s in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_toxicity(spark, empty):
    r = random.Random(2)
    made = [(i, prose(80, r) + (" vile scum" if i % 5 == 0 else "") + " " + prose(20, r)) for i in range(600)]
    df = spark.createDataFrame([*made, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(401, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    assert all((got[i].score >= 0.3) == (i % 5 == 0) for i, _ in made)
    assert got[400].segments and got[900].score == got[901].score < 0.3
    flat = toxicity.fit(df, labels.limit(0))
    assert {x.score for x in toxicity.score(df, flat).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0
