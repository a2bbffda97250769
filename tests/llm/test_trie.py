"""Operator 12 against a plain definition and its SQL, with nulls, ties, repeated rows, turnless conversations and hot prefixes."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.llm import queries, trie


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    """The rows of op12 for rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            by[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c > 0 else -(abs(c) % 20))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0) for x in under)
        ends = ",".join(str(c) for c in sorted(convs) if full[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
MADE = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of many words") for c in range(40, 75) for t in range(c % 5)]
    + [(c, 0, "user", "hi there") for c in (-7, -27, -20, 100, 101, 119)] + [(-7, 1, None, "x y"), (-7, None, "system", None), (0, 0, "user", "hi there"), (0, 1, "assistant", ""), (0, 2, "assistant", None)]
    + [(200, 1, "user", "b"), (200, 1, "user", "a"), (200, 1, "user", "a"), (201, 5, "user", "a"), (None, 0, "user", "lost"), (210, 0, "", " \t "), (220, 3, "assistant", "long " * 20_000), (221, 3, "assistant", "long " * 20_000)]
)


@pytest.mark.parametrize("rows", [MADE, [(5, 0, "user", "only one"), (5, 1, "user", None)], [(3, None, None, None)], [(-7, 0, "a", "b"), (-7, 1, "a", "b")]])
def test_equals_the_plain_definition_and_sql(spark, tmp_path, rows):
    at = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, node string").write.parquet(at)
    got = sorted(map(tuple, queries.op12_prefix_trie(spark, str(tmp_path)).select(COLUMNS).collect()), key=str)
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{at}/*.parquet'")
    assert sorted(con.sql(f"select {', '.join(COLUMNS)} from ({queries.OP12_SQL})").fetchall(), key=str) == got


def test_registered_query_on_the_smallest_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_prefix_trie(spark, sf).select(COLUMNS).collect()), key=str) == plain(rows)


def test_a_node_in_which_many_conversations_end(spark):
    n = 5000
    rows = spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same words").alias("text"))
    turns = trie.numbered(rows)
    found = trie.prefix_trie(turns, turns.select("conv_id", F.lit(1).cast("long").alias("n_turns")))
    lists = {(r.depth, r.node): r.ends_sha256 for r in trie.list_digests(found.ends, run=64).collect()}
    assert lists == {(1, 0): sha(",".join(map(str, range(n))))}
    assert {(r.depth, r.n_convs, r.saved_tokens) for r in found.nodes.collect()} == {(0, n, 2 * (n - 1)), (1, n, 2 * (n - 1))}
    assert Counter(len(r) for r in found.ends.collect()) == {3: n}


def test_no_conversation_no_node(spark):
    rows = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    for some in (rows, rows.limit(0)):
        found = trie.prefix_trie(*queries.rebuilt_turns(some))
        assert found.nodes.count() == 0 and found.ends.count() == 0
