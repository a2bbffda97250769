"""Operator 13 against plain definitions and its SQL; crowded buckets, accents, ties, nulls, long words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from waymark.llm import queries, spelling

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(_AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_registered_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = counts(docs)
    rows = sorted(map(tuple, queries.op13_spelling(spark, sf).select(COLUMNS).collect()))
    assert len(rows) == len(n) > 500 and rows == groups(n)


def test_nulls_slips_long_words_and_sql(spark, tmp_path):
    rng = random.Random(1)
    base = ["necessary", "élèvesé", "ÀÖ×÷ÿß", "thousand", "x" * 4000, "x" * 4001, "x" * 1999 + "y" + "x" * 2000]
    docs = [(i, " ".join(rng.choices(base, k=200))) for i in range(150)] + [(None, "necessary Thousand-thousands thousands " * 9), (1, None), (2, ""), (3, "necessary " * 5), (3, "necessary " * 5), (4, "neçessary " * 5 + "ÉLÈVESÉ élèves " * 6)]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, word string").write.parquet(at)
    got = sorted(map(tuple, queries.op13_spelling(spark, str(tmp_path)).select(COLUMNS).collect()))
    assert got == groups(counts(docs))
    assert any(r[1] for r in got) and any("è" in r[0] and r[4] for r in got)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/*.parquet'")
    assert sorted(con.sql(f"select {', '.join(COLUMNS)} from ({queries.OP13_SQL})").fetchall()) == got


@pytest.mark.parametrize("most", [0, 1, 7, 100, 10**9])
def test_crowded_buckets_lose_no_pair(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("abé", k=rng.choice([1, 2, 3, 5, 6, 7]))) for _ in range(300)} | {"prefix" + a + b for a in "abcdefgh" for b in "abcdefgh"} | {"aaaaaa", "aaaaaaa", "aaaaaaaa"}
    n = {w: 1 for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = defaultdict(set)
    rows = spelling.near_pairs(df, most).collect()
    for r in rows:
        got[r.word].add(r.other)
    assert len(rows) == sum(map(len, got.values()))
    assert all(got[w] == {v for v in words if one_edit(w, v)} for w in words)


def test_chains_end_at_the_root_and_ties_take_the_smaller_word(spark):
    made = [("aaaaaa", 1), ("aaaaab", 5), ("aaaabb", 25), ("aaabbb", 125), ("aabbbb", 700), ("zzzzzz", 5), ("zzzzzy", 25), ("zzzzzx", 25), ("alone", 3)]
    got = sorted(map(tuple, spelling.group_variants(spark.createDataFrame(made, "word string, n long")).select(COLUMNS).collect()))
    assert got == groups(dict(made))
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "aabbbb" and {r[0]: r[1] for r in got}["zzzzzz"] == "zzzzzx"
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
