"""Minimax contiguous sharding (operator 10).

Rows with equal texts form an atomic group; groups are ordered by the SHA-256 digest of the text, so the order depends on
content alone. A binary search finds the smallest capacity at which a greedy pass over that order fits into the shards. The
cuts are made within it: each shard ends as near to an equal part of what is left as the capacity allows the shards after it,
so the slack of the last greedy shard is spread over all. Groups larger than a fair share take a shard each first; the search deals with the rest.

The driver never sees the groups: it holds totals for digest prefixes (4096 at first). A greedy pass over prefixes gives an
early and a late bound of every cut; only prefixes in which a cut of the current capacity is undecided are split further,
256 ways, by one aggregate. Their number follows the shard count and the search depth, not the data. Shard bounds are digest
prefixes, so rows find their shard by comparison without a join. Slots are numbered in blocks: counts by (shard, block) give
each block's first slot, and a row number within the block the rest; no shard passes through one task.

Cases: null text counts as empty (16 bytes, crc32 0) and shares the group of empty texts; ties and repeated rows get
distinct slots (rows alike in ``keep`` and text are numbered in one task); fewer groups than shards leave shards empty; an empty table gives an empty result; extra columns pass
through ``keep``, clashing result names get an underscore.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import column_names, stage

#: Rows that one numbering task takes, about.
BLOCK_ROWS = 1_000_000


class _Order:
    """Byte totals of the ordered groups by digest prefix, split on demand."""

    def __init__(self, groups: DataFrame):
        self.groups, self.nodes = groups, {}
        self._load(self._sums(groups, 3))

    @staticmethod
    def _sums(groups: DataFrame, size: int) -> list:
        return groups.groupBy(F.substring("digest", 1, size).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()

    def _load(self, rows) -> None:
        self.nodes.update({r["p"]: (r["b"], r["n"]) for r in rows})
        self.keys = sorted(self.nodes)
        self.ends = list(accumulate(self.nodes[k][0] for k in self.keys))
        self.total = self.ends[-1] if self.ends else 0

    def split(self, keys: set[str]) -> None:
        for size in {len(k) for k in keys}:
            part = [k for k in keys if len(k) == size]
            rows = self._sums(self.groups.filter(F.substring("digest", 1, size).isin(part)), size + 2)
            for k in part:
                del self.nodes[k]
            self._load(rows)

    def passes(self, cap: int, shards: int) -> tuple[list[str] | None, bool, set[str]]:
        """First keys of the shards if ``cap`` surely fits; whether it may fit; the undecided prefixes."""
        early, late, firsts, open_keys = 0, 0, [], set()
        for _ in range(shards):
            i = bisect_right(self.ends, early)
            firsts.append(self.keys[i] if early < self.total else "~")
            early, late = self._cut(early + cap, open_keys, False), self._cut(late + cap, open_keys, True)
        return (firsts if early >= self.total else None), late >= self.total, open_keys

    def _cut(self, limit: int, open_keys: set[str], late: bool) -> int:
        i = bisect_right(self.ends, limit)
        if i < len(self.keys) and self.nodes[self.keys[i]][1] > 1:
            open_keys.add(self.keys[i])
            if late:
                return limit
        return self.ends[i - 1] if i else 0


    def spread(self, cap: int, shards: int) -> list[str]:
        """First keys of shards within ``cap``, each near an equal part of what is left; a greedy pass within ``cap`` is known to fit."""
        at, out = 0, []
        for left in range(shards, 0, -1):
            i = bisect_right(self.ends, at)
            out.append(self.keys[i] if at < self.total else "~")
            i = bisect_right(self.ends, at + -(-(self.total - at) // left))  # ends[i - 1] is at most the aim, ends[i] beyond it
            aims = [self.ends[j] for j in (i, i - 1) if 0 <= j < len(self.ends) and at <= self.ends[j] <= at + cap]
            aims.sort(key=lambda end: abs(end - at - (self.total - at) / left))
            at = next((end for end in aims if self._reaches(end, cap, left - 1)), self._cut(at + cap, set(), False))
        return out

    def _reaches(self, at: int, cap: int, shards: int) -> bool:
        """Whether a greedy pass over whole prefixes surely gets from ``at`` to the end."""
        for _ in range(shards):
            at = self._cut(at + cap, set(), False)
        return at >= self.total


def minimax_bounds(groups: DataFrame, shards: int) -> tuple[list[str], list[str], int]:
    """(first digest prefix of each shard, digests that have a shard of their own, capacity). ``groups``: digest, bytes."""
    own, total = [], groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    top = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()
    while len(own) < min(len(top), shards - 1) and top[len(own)]["bytes"] * (shards - len(own)) > total:
        total -= top[len(own)]["bytes"]
        own.append(top[len(own)]["digest"])
    rest, left = groups.filter(~F.col("digest").isin(own)) if own else groups, shards - len(own)
    order, most = _Order(rest), top[len(own)]["bytes"] if len(own) < len(top) else 0
    lo = max(most, -(-total // left))
    hi, best = lo + most, None
    while lo < hi or best is None:
        cap = (lo + hi) // 2
        fits, may, undecided = order.passes(cap, left)
        if fits is not None:
            hi, best = cap, fits
        elif not may:
            lo = cap + 1
        else:
            order.split(undecided)
    return order.spread(hi, left) if best else best, own, hi


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, overhead: int = 16) -> DataFrame:
    """``keep`` columns plus size, text_crc32, law, shard, slot and grown_shard."""
    keep = [id_col] if keep is None else keep
    held = [f"k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, held)), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    rows = stage(rows, "shard-rows")
    groups = stage(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    firsts, own, _ = minimax_bounds(groups, shards)
    placed = rows.withColumn("shard", _shard(F.col("digest"), firsts, own).cast("int"))
    blocks = max(4, -(-rows.count() // (BLOCK_ROWS * shards)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(*held, "digest"), F.lit(blocks)))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "block", F.coalesce("start", F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy(*held, "digest")) - 1
    placed = placed.withColumn("nth", nth).join(F.broadcast(starts), ["shard", "block"])  # shards x blocks rows, a few bytes each
    made = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("bytes"), "shard": F.col("shard"), "slot": (F.col("start") + F.col("nth")).cast("long"), "grown_shard": F.lit(None).cast("int")}
    names = column_names(docs.select(*keep), *made)
    return placed.select(*(F.col(k).alias(c) for c, k in zip(keep, held)), *(v.alias(n) for v, n in zip(made.values(), names)))


def _shard(digest: Column, firsts: list[str], own: list[str]) -> Column:
    rest = F.lit(0)
    for first in firsts[1:]:
        rest = rest + F.when(digest >= first, 1).otherwise(0)
    for i, one in enumerate(own):
        rest = F.when(digest == one, len(firsts) + i).otherwise(rest)
    return rest
