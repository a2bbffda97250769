"""Each registered opN query and the pipeline on the smallest tables, against its SQL or a plain definition, with production parameters."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from waymark.llm import byte_bpe, language_id, quality_rules, queries, toxicity
from waymark.llm.common import stage, table

D = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select doc_id, text from documents order by doc_id").fetchall()


def run(name, spark, sf):
    return {r[0]: r for r in queries.QUERIES[name](spark, sf).collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_decontaminate", "op9_line_dedup"])
def test_equals_sql(name, spark, sf, con):
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_op3_decodes_the_nearest_codeword(spark, sf, con):
    rows = con.execute("select doc_id, text, lang from documents").fetchall()
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if fold(i, 5) and lang is not None:
            counts[lang].update(language_id.grams(t or "").tolist())
    langs = sorted(counts)
    share = {x: [(counts[x][b] + 0.5) for b in range(1 << language_id.BITS)] for x in langs}
    share = {x: [v / sum(vs) for v in vs] for x, vs in share.items()}
    code = language_id.codewords(len(langs)).tolist()
    odds = []
    for b in range(len(code[0])):
        side = {s: [x for k, x in enumerate(langs) if code[k][b] == s] for s in (1, -1)}
        odds.append([math.log(sum(share[x][v] for x in side[1]) / len(side[1])) - math.log(sum(share[x][v] for x in side[-1]) / len(side[-1])) for v in range(1 << language_id.BITS)])
    gain = [[max(1e-6, code[k][b] * sum(p * o for p, o in zip(share[x], odds[b]))) for b in range(len(odds))] for k, x in enumerate(langs)]
    scale = 1 / (sum(map(sum, gain)) / sum(map(len, gain)))
    got = run("op3_language_id", spark, sf)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        g = language_id.grams(t).tolist() or [0]
        margin = [scale * sum(o[v] for v in g) / len(g) for o in odds]
        loss = [sum(w / sum(gain[k]) * math.log1p(math.exp(-c * m)) for w, c, m in zip(gain[k], code[k], margin)) for k in range(len(langs))]
        weight = [math.exp((min(loss) - x) * 8 * min(1.0, len(g) / language_id.FULL_GRAMS)) for x in loss]
        assert got[i].lang_pred == langs[loss.index(min(loss))] and got[i].held_out == (fold(i, 5) == 0)
        assert got[i].score == pytest.approx(max(weight) / sum(weight), abs=1e-3)


def test_op4_verdict_follows_from_the_rules(spark, sf, docs):
    _, rules = quality_rules.apply(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = run("op4_quality_rules", spark, sf)
    assert len(got) == len(docs)
    for i, t in docs:
        n, chars, symbols, dup, repeat = brute.text_stats(t)
        w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        own = {
            "mean_word": chars / max(n, 1), "symbols": symbols / max(n, 1), "dup_lines": dup / max(len(lines), 1), "repeats": repeat / max(n, 1), "distinct": len(set(w)) / max(n, 1),
            "capitals": len(re.findall("[A-Z]", t or "")) / max(chars, 1), "marks": len(re.findall(r"[!-/:-@\[-`{-~]", t or "")) / max(n, 1), "words": float(n), "line_words": n / max(len(lines), 1),
        }
        failed = n < 20 or 100 * repeat > 30 * n
        bad = any(all((own[c.feature] > c.at) == c.above for c in rule) for rule in rules)
        assert tuple(got[i])[1:] == (n, chars, symbols, dup, repeat, failed, not failed and not bad)


def test_op5_removes_every_repeated_string(spark, sf, docs):
    assert sorted(map(tuple, run("op5_suffix_dedup", spark, sf).values())) == brute.suffix_dedup(docs, 400)


def test_op6_links(spark, sf, docs):
    assert sorted(map(tuple, run("op6_near_dedup", spark, sf).values())) == [(d, n, c, c == d) for d, n, c in brute.near_dedup(docs, 85)]


def test_op7_equals_tiktoken(spark, sf, docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=queries.tokenizer_pattern(), mergeable_ranks=byte_bpe.read_ranks(queries.tokenizer_path()), special_tokens={})
    got = run("op7_byte_bpe", spark, sf)
    for i, t in docs:
        ids = enc.encode_ordinary(t or "")
        assert tuple(got[i]) == (i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode()))


def plain_segments(scores):
    """All maximal scoring segments by definition: best segment first, then the rest to its left and right."""
    best, at = 0.0, None
    for a in range(len(scores)):
        s = 0.0
        for b in range(a, len(scores)):
            s += scores[b]
            if s > best + 1e-9:
                best, at = s, (a, b + 1)
    if at is None:
        return []
    return [x for x in plain_segments(scores[: at[0]])] + [(at[0], at[1], best)] + [(a + at[1], b + at[1], s) for a, b, s in plain_segments(scores[at[1] :])]


def test_op8_scores_follow_from_counts(spark, sf, con, docs):
    labels = {}
    for i, v in con.execute("select doc_id, toxic from labels where toxic is not null").fetchall():
        if fold(i, 4) != 2:
            labels[i] = max(v, labels.get(i, 0))
    text = dict(docs)
    seen = {0: Counter(), 1: Counter()}
    for i, v in labels.items():
        if i in text and zlib.crc32(f"fit{i}".encode()) % 3:
            for w in set(toxicity.words_of(text[i])):
                seen[v].update(toxicity.features(w))
    model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels").filter(f"doc_id in ({', '.join(map(str, labels))})"))
    prior = {b: toxicity.PRIOR * max(0.5, seen[0][b] + seen[1][b]) for b in range(1 << toxicity.BITS)}
    total, n1, n0 = sum(prior.values()), sum(seen[1].values()), sum(seen[0].values())

    def word_score(w):
        best = None
        for b in toxicity.features(w):
            y1, y0 = seen[1][b] + prior[b], seen[0][b] + prior[b]
            odds = math.log(y1 / (n1 + total - y1)) - math.log(y0 / (n0 + total - y0))
            z = odds / math.sqrt(1 / y1 + 1 / y0) if seen[0][b] + seen[1][b] else 0.0
            if best is None or abs(z) > abs(best[0]):
                best = (z, odds)
        z, odds = best
        return odds if z >= toxicity.SIGNIFICANT else max(odds, -2.0) - toxicity.DRIFT if z <= -toxicity.SIGNIFICANT else -toxicity.DRIFT

    got = run("op8_toxicity", spark, sf)
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i].held_out == (fold(i, 4) == 2) and got[i].predicted == int(got[i].score >= 0.3)
        words = toxicity.words_of(t)
        if len(words) > 150:
            continue  # the plain segments take cubic time
        tops = sorted((s for *_, s in plain_segments([word_score(w) for w in words])), reverse=True)[: toxicity.MOST]
        space, best, s = math.log(model.k * max(len(words), 1)), -math.log(model.k * max(len(words), 1)), 0.0
        for r, x in enumerate(tops, 1):
            s += x
            best = max(best, model.lam * s - r * space + math.lgamma(r + 1))
        x = model.slope * min(max(best, -30), 30) + model.shift
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-min(max(x, -30), 30))), rel=1e-6)


def test_op10_law_groups_slots_and_capacity(spark, sf, docs):
    got = run("op10_sharding", spark, sf)
    size = {i: len((t or "").encode()) + 16 for i, t in docs}
    by, group, load = defaultdict(list), {}, Counter()
    for i, t in docs:
        r = got[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (size[i], zlib.crc32((t or "").encode()), "bytes", None) and 0 <= r.shard < 40
        assert group.setdefault(t or "", r.shard) == r.shard
        by[r.shard].append(r.slot)
        load[r.shard] += size[i]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    groups = Counter()
    for i, t in docs:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += size[i]
    order, own, total = sorted(groups), [], sum(groups.values())
    for d, b in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if len(own) < 39 and b * (40 - len(own)) > total:
            own.append(d)
            total -= b
        else:
            break
    rest = [groups[d] for d in order if d not in own]

    def fits(cap):
        n, left = 1, cap
        for b in rest:
            if b > left:
                n, left = n + 1, cap
            left -= b
            if left < 0:
                return False
        return n <= 40 - len(own)

    alone = {group[t] for t in group if hashlib.sha256(t.encode()).hexdigest() in own}
    most = max(load[s] for s in range(40) if s not in alone)
    assert fits(most) and not fits(most - 1)


def test_pipeline_stage_by_stage(spark, sf, con):
    docs = table(spark, sf, "documents")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = rows(docs)
    scored = run("op8_toxicity", spark, sf)
    steps = dict(corpus_pipeline.STAGES)
    docs = stage(steps["toxicity"](spark, docs, sf), "test")
    now = rows(docs)
    assert now == {i: t for i, t in before.items() if scored[i].score < corpus_pipeline.TOXIC}
    docs = stage(steps["line_dedup"](spark, docs, sf), "test")
    assert rows(docs) == {d: t for d, _, _, t in brute.line_dedup(list(now.items()))}
    assert all(r.n_chars == len(r.text or "") for r in docs.collect() if r.text is not None)
    now = rows(docs)
    docs = stage(steps["near_dedup"](spark, docs, sf), "test")
    assert rows(docs) == {d: now[d] for d, _, c in brute.near_dedup(sorted(now.items()), corpus_pipeline.ALIKE) if c == d}
    now, bench = rows(docs), con.execute("select item_id, text from benchmark").fetchall()
    docs = stage(steps["decontamination"](spark, docs, sf), "test")
    assert rows(docs) == {d: now[d] for d, _, hit, _ in brute.decontaminate(list(now.items()), bench) if not hit}
    last = steps["byte_bpe"](spark, docs, sf).collect()
    codec = byte_bpe.codec_of(queries.tokenizer_path(), queries.tokenizer_pattern())
    assert {r.doc_id: r.decoded for r in last} == {i: t or "" for i, t in rows(docs).items()}
    assert all(codec.decode_bytes(np.array(r.ids, "<u4").tobytes()) == (r.text or "").encode() and r.n_tokens == len(r.ids) for r in last)
