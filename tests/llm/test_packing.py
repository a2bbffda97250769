"""Operator 11: pieces against the tokenizers library, placements against the plain sum of squares."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waymark.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return lambda text: model.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, texts, plain, window=2048):
    """Every id in one piece, pieces cut from the ids of their document, sequences gapless and at most a window; padding."""
    ids = {d: plain(t) for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
    assert by_doc.keys() == ids.keys()
    for parts, total in [(p, len(ids[d])) for d, p in by_doc.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total or total is None
    sizes = [sum(n for _, n in p) for p in by_sequence.values()]
    assert max(sizes) <= window
    return sum(window - n for n in sizes if n & (n - 1)), sizes


def test_registered_query(spark, sf, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_packing(spark, sf).collect()
    padding, sizes = check(rows, texts, plain)
    assert padding == 0
    assert sum(n == 2048 for n in sizes) > 0.8 * len(sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab Zé .,!?'1２\n\t 　\u0085\x1c_日<|>")), max_size=60), max_size=8))
def test_encoder_equals_the_library(texts):
    texts = texts + ["<|endoftext|> a<|endoftext|>", "it's  we'll. 'S ... end.", "a word.\nLine, b c\nd e.\n\nf g.\n h i\n.j k_\nl m_.\nn"]
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    got = packing.encoder_of(PATH).encode(texts)
    assert got == [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_memo_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 3)
    monkeypatch.setattr(packing, "MEMO_UNITS", 2)
    one, two = packing.Encoder(PATH), packing.encoder_of(PATH)
    texts = ["some words here. and here", "words, again some words", "x" * 100 + " " + "y" * 100 + "."]
    assert [one.encode([t]) for t in texts * 2] == [two.encode([t]) for t in texts * 2]
    assert max(map(len, (one.words, one.units))) < 12 and all(len(w) <= packing.MEMO_CHARS for w in (*one.words, *one.units))


@pytest.mark.parametrize("window", [8, 64])
def test_each_placement_has_the_least_sum_of_squares(window):
    rng, w = random.Random(5), packing.Windows(window)
    fills: list[int] = []
    for i in range(600):
        size = rng.randint(1, window - 1)

        def squares(level):
            after = fills.copy()
            if level:
                after.remove(level)
            after += [level + size] if level + size < window else []
            return sum(after.count(h) ** 2 for h in set(after))

        options = {h: squares(h) for h in {0, *fills} if h + size <= window}
        level = w.level_for(size)
        assert options[level] == min(options.values())
        assert level == max(h for h, v in options.items() if v == min(options.values()))
        w.place((i, 0, b"\0" * 4 * size, size))
        if level:
            fills.remove(level)
        fills += [level + size] if level + size < window else []
        assert sorted(fills) == sorted(np.repeat(np.arange(window + 1), w.count).tolist())
    assert sum((window - h) for h in fills) < 40 * window  # of about 300 windows
    sizes = [sum(len(p[2]) // 4 for p in one) for one in w.finish()]
    assert sum(sizes) == sum(fills) and all(n == window or n & (n - 1) == 0 for n in sizes)


def test_nulls_long_texts_repeats_other_columns(spark, plain):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "a b", 5: "Ünï\u0000cödé ..", 6: "z" * 5_000}
    rows = [(i, t, {"k": i}, "own") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, start map<string,int>, text_in string").repartition(3, "doc_id")
    got = packing.pack(df, PATH, window=64).collect()
    assert got[0].__fields__ == ["doc_id", "text", "start", "text_in", "start_", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    back = defaultdict(list)
    for r in sorted(got, key=lambda r: r["start_"]):
        back[r.doc_id] += r.ids
        assert r["start"] == {"k": r.doc_id} and r.text == texts[r.doc_id]
    assert dict(back) == {i: plain(t) for i, t in texts.items()}
    twice = packing.pack(df.filter("doc_id = 4").union(df.filter("doc_id = 4")), PATH, keep=[], digests=True).collect()
    assert sum(r.length for r in twice) == 2 * len(plain("a b"))
    assert packing.pack(df.limit(0), PATH).count() == 0
    assert packing.pack(df, PATH, keep=["doc_id"], digests=True).filter("doc_id is null").count() == 0


def test_a_task_holds_kept_columns_over_slices(spark, plain, monkeypatch):
    texts = {i: "w " * (i % 50) for i in range(1500)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    padding, _ = check(packing.pack(df, PATH, keep=["doc_id"], digests=True).collect(), texts, plain)
    assert padding == 0
