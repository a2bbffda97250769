"""Prefix trie of conversations (operator 12).

A node of depth d is a distinct sequence of d turns; it is known by its depth and its smallest member, as nodes of a depth share no
member. Construction is level by level: the live conversations of a depth, with the node that each is in, meet their next turn and
are grouped by (node, turn) with the minimum conv_id; a join back moves them to the new node. A conversation that is alone in its
node leaves the levels: what follows is a chain of its own, read off its turns at the end. Then the levels are joined in reverse, children
aggregated by parent, which rolls up leaves and savings. A level is a few jobs; there are as many as the longest shared prefix has turns.

Turns are known by a SHA-256 digest, so texts are read once and never shuffled. A first turn that a third of all conversations
share is a hot key only of partial aggregates and of one side of an equi-join, which adaptive execution splits. Each step is
written to the shared folder. The conversations that end in a node are never gathered: ``list_digests`` sorts them by range,
joins runs of ``RUN`` ids in tasks, and feeds a node's runs in order to the hash, which holds one run at a time.

Cases: null role and null text are empty; null turns come first; turns with equal numbers are ordered by their digest, so repeated
rows are turns of their own; rows with a null conv_id belong to no conversation and are left out; a conversation without turns
is a member of the root; without any conversation there is no node, not even the root; very long texts are digested whole; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import shared_dir, ship, stage, stage_at

#: Ids that are joined to one string before a node's strings meet.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"


class Trie(NamedTuple):
    """``nodes``: depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ``ends``: depth, node, conv_id."""

    nodes: DataFrame
    ends: DataFrame


def turn_key(role: Column, text: Column) -> Column:
    """32 bytes that tell (role, text) apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth (the turn's place from 1 on), key, n_words of each turn, written once."""
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).alias("turn"), turn_key(F.col(role_col), F.col(text_col)).alias("key"), n_words.alias("n_words"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key")).cast("long")
    return stage(rows.select("conv_id", nth.alias("depth"), "key", "n_words"), "trie-turns")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of ``convs`` (conv_id once each, n_turns) with their ``turns`` (conv_id, depth gapless from 1, key, n_words)."""
    spark = turns.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    root = convs.agg(F.min("conv_id"), F.count("*")).first()
    top = spark.range(1).select(F.lit(root[0]).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(root[1]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_turns"))
    if root[1] == 1:
        top = top.drop("n_turns").crossJoin(convs.select("n_turns"))  # one row each
    levels = [stage_at(top.filter(F.lit(root[1] > 0)), f"{folder}/level/depth=0")]
    moved = stage_at(convs.select("conv_id", F.lit(root[0]).cast("long").alias("node"), "n_turns", F.lit(root[1]).cast("long").alias("n_convs")), f"{folder}/moved/depth=0")
    while True:
        d = len(levels)
        live = moved.filter((F.col("n_convs") > 1) & (F.col("n_turns") >= d)).select("conv_id", F.col("node").alias("parent"), "n_turns")
        step = stage(live.join(turns.filter(F.col("depth") == d).select("conv_id", "key", "n_words"), "conv_id"), "trie-step")
        made = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), F.max("n_turns").alias("n_turns"))
        level = stage_at(made, f"{folder}/level/depth={d}")
        if level.isEmpty():
            break
        levels.append(level)
        moved = stage_at(step.join(level.select("parent", "key", "node", "n_convs"), ["parent", "key"]).select("conv_id", "node", "n_turns", "n_convs"), f"{folder}/moved/depth={d}")
    below = None
    for d in reversed(range(len(levels))):
        rows = levels[d].select("node", "parent", "n_convs", "n_turns", ((F.col("n_convs") - 1) * F.col("n_words")).alias("own"))
        if below is None:
            below = rows.limit(0).select("node", F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        rows = rows.join(below, "node", "left")
        children = F.when(F.col("n_convs") == 1, (F.col("n_turns") > d).cast("long")).otherwise(F.coalesce("children", F.lit(0)))
        rows = rows.select("node", "parent", "n_convs", children.alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
        rolled = stage_at(rows, f"{folder}/rolled/depth={d}")
        below = rolled.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    read = lambda part, schema: spark.read.schema(f"{schema}, depth long").parquet(f"{folder}/{part}")
    shared = read("rolled", "node long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    shared = shared.select("depth", F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    at = read("moved", "conv_id long, node long, n_turns long, n_convs long")
    alone = at.filter("n_convs = 1").select("conv_id", F.col("depth").alias("since"), "n_turns")
    chain = turns.select("conv_id", "depth").join(alone, "conv_id").filter("depth > since")
    chain = chain.select("depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    ends = at.filter("n_convs = 1 or n_turns = depth").select(F.col("n_turns").alias("depth"), "node", "conv_id")
    return Trie(shared.unionByName(chain), ends)


def list_digests(ends: DataFrame, run: int = RUN) -> DataFrame:
    """depth, node, sha256 of the node's decimal conv_ids, ascending and joined by commas; a row of a task holds up to ``run`` ids."""
    ship(ends.sparkSession)
    by = ["depth", "node"]
    inner = ends.repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id")
    runs = inner.mapInArrow(partial(_join_runs, run=run), "depth long, node long, first long, ids string")
    return runs.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(_hash_runs, "depth long, node long, ends_sha256 string")


def _join_runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    at, ids = None, []
    names = ["depth", "node", "first", "ids"]
    row = lambda: (*at, ids[0], ",".join(map(str, ids)))
    for batch in batches:
        out = []
        for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, node) != at or len(ids) == run:
                if ids:
                    out.append(row())
                at, ids = (depth, node), []
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row()], names=names)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, digest = None, None
    names = ["depth", "node", "ends_sha256"]
    for batch in batches:
        out = []
        for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (depth, node) == at:
                digest.update(b",")
            else:
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (depth, node), hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], names=names)
