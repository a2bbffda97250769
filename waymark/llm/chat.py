"""Chat formatting of reply trees (operator 1), DataFrame functions only.

Messages form trees by parent. Iterative self-joins double each node's ancestor pointer, so a path of ``d`` messages takes
log2(d) rounds; the sums gathered on the way give each leaf its branch score and depth. Branches are ranked within a tree,
and the chosen leaves gather their ancestors through the kept pointer levels, again in log2(d) joins. Every path becomes one
conversation in the template ``<turn ROLE>TEXT</turn>\\n``. Inside roles and texts ``\\``, ``<`` and ``>`` are written ``\\b``,
``\\l`` and ``\\g``, so no text can forge a control string and unescaping is exact.

Each round is written to the shared folder. A node with very many replies is a hot key on one side of an equi-join only,
which AQE splits. One formatted conversation is one value by definition; nothing else is gathered per key.

Cases: null text and null role count as empty; the messages with a null tree (conversation id) are one tree, whose output has a
null tree; stored turns with a null turn come last; repeated rows of a conversation stored by turn are turns of their own; of
messages that repeat one (tree, node) the least by parent, score, role and text counts (nulls first); messages with a null node
are left out; a parent that is missing makes its reply a root; a cycle has no root, so its nodes (and replies below them) give
no path; equal scores fall back to depth, then node id; an empty table gives no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stage

OPEN, MID, CLOSE = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _same() -> Column:
    """The join on (tree, node) with (kt, kn); a null tree is a tree like any other."""
    return F.col("tree").eqNullSafe(F.col("kt")) & (F.col("node") == F.col("kn"))


def one_per_node(messages: DataFrame) -> DataFrame:
    """tree, node, parent, score, role, text: one row for each (tree, node)."""
    row = F.struct("parent", F.col("score").cast("double").alias("score"), "role", "text")
    return messages.filter("node is not null").groupBy("tree", "node").agg(F.min(row).alias("m")).select("tree", "node", "m.*")


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Hops (tree, node, ptr), level k reaching 2**k ancestors up, and (tree, node, total, steps) of all that reach a root.

    A node leaves the rounds as soon as its pointer has passed the root, so a round joins only what is still on its way.
    """
    parent = nodes.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    at = nodes.join(parent, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("parent") == F.col("pn")), "left")
    at = stage(at.select("tree", "node", F.col("pn").alias("ptr"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "chat-level")
    done, hops, most = at.filter("ptr is null"), [], at.count()
    now = at.filter("ptr is not null")
    while now.limit(1).count() and 2 ** len(hops) <= most:
        hops.append(now.select("tree", "node", "ptr"))
        up = done.unionByName(now).select(F.col("tree").alias("ut"), F.col("node").alias("un"), F.col("ptr").alias("up"), F.col("total").alias("more"), F.col("steps").alias("far"))
        joined = now.join(up, F.col("tree").eqNullSafe(F.col("ut")) & (F.col("ptr") == F.col("un")))
        at = stage(joined.select("tree", "node", F.col("up").alias("ptr"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("far")).alias("steps")), "chat-level")
        done, now = done.unionByName(at.filter("ptr is null")), at.filter("ptr is not null")
    return hops, done.select("tree", "node", "total", "steps")


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """Rows (tree, leaf, branch, depth, node) of the ``top`` best root-to-leaf paths of each tree. Messages: tree, node, parent, score, one row a node."""
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    hops, full = _levels(nodes)
    leaves = full if not hops else full.join(hops[0].select(F.col("tree").alias("kt"), F.col("ptr").alias("kn")).distinct(), _same(), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), "node"))
    chosen = leaves.withColumn("branch", rank).filter(F.col("branch") <= top).select("tree", F.col("node").alias("leaf"), "branch", "node")
    found = stage(chosen, "chat-path")
    for hop in reversed(hops):
        hop = hop.select(F.col("tree").alias("kt"), F.col("node").alias("kn"), "ptr")
        found = stage(found.unionByName(found.join(hop, _same()).select("tree", "leaf", "branch", F.col("ptr").alias("node"))), "chat-path")
    return found.join(full.select(F.col("tree").alias("kt"), F.col("node").alias("kn"), F.col("steps").alias("depth")), _same()).select("tree", "leaf", "branch", "depth", "node")


def format_paths(messages: DataFrame, top: int = 1, loss_role: str = "assistant", unique: bool = False) -> DataFrame:
    """One row a path: tree, leaf, branch, formatted and loss_spans. ``unique``: nodes are known to be given once (as by ``linear``).

    ``loss_spans`` lists the texts of ``loss_role`` in order: turn, start and end in the formatted conversation, and ``at``,
    the start within the turn's block; all in code points.
    """
    messages = messages if unique else stage(one_per_node(messages), "chat-nodes")
    block = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), escape(F.col("text")), F.lit(CLOSE))
    rows = paths(messages, top).join(messages.select(F.col("tree").alias("kt"), F.col("node").alias("kn"), "role", "text"), _same())
    rows = rows.select("tree", "leaf", "branch", "depth", "role", block.alias("block"), F.length(escape(F.col("text"))).cast("long").alias("len"), (F.length(escape(F.col("role"))) + len(OPEN) + len(MID)).alias("at"))
    before = F.coalesce(F.sum(F.length("block")).over(Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + F.col("at"))
    span = F.when(F.col("role") == loss_role, F.struct((F.col("depth") - 1).cast("int").alias("turn"), "start", (F.col("start") + F.col("len")).alias("end"), "at"))
    return rows.groupBy("tree", "leaf", "branch").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "block"))), lambda x: x["block"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )


def linear(rows: DataFrame, tree_col: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of conversations that are stored turn by turn: each turn replies to the one before (ties: role, then text)."""
    nth = F.row_number().over(Window.partitionBy(tree_col).orderBy(F.asc_nulls_last(order), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).cast("long")
    return rows.withColumn("node", nth).select(F.col(tree_col).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text)."""
    blocks = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)
    part = lambda b: F.split(F.substring(b, len(OPEN) + 1, 2**31 - 1), MID, 2)
    return F.transform(blocks, lambda b: F.struct(unescape(F.get(part(b), 0)).alias("role"), unescape(F.get(part(b), 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    blocks = F.split(formatted, CLOSE, -1)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(blocks, s["turn"]), s["at"] + 1, (s["end"] - s["start"]).cast("int")))), "")
