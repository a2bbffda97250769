"""MinHash near-dedup with bottom-k sketches (operator 6).

A text's set holds the hashes of its distinct five-word shingles (lower-cased A-Z, words between ASCII white space); its sketch
holds the ``K`` smallest values of that one hash. Texts with equal sets form a class, and one of each stands for it.

Candidates: two sets alike enough share ``shared_values`` of their sketch values (five deviations below the mean), so they
share one of the rarest ``K - shared_values + 1`` of either; only these values get inverted lists, which keeps values that very many
documents hold out of the lists unless whole families share little else. Lists of up to ``SHORT`` members give their pairs; sizes and the estimate from the
union of two sketches filter them, and the exact Jaccard index of the full sets decides. A longer list is mostly one family
of copies: its members meet in tasks of at most ``BLOCK`` shingles with their full sets. There the first member leads; a member alike a leader is
linked to it and done, any other leads as well. Only where this leaves members apart are non-leaders compared, and only those that the
triangle inequality of the Jaccard distance leaves in reach of another leader's followers. Members that share too little with the
rest of the long lists for any link are left out first, by an exact bound, and lists that the short ones have already joined are
left out as well. Lists of several blocks then compare one member of each component, and only lists that stay apart are dealt
out as pairs of blocks, so no task gathers more than two blocks and no link is lost.

Equal sets never form pairs, links and components stay distributed, and every intermediate is a table in the shared folder.
128 bits of hash stand for sets, 64 for shingles.

Cases: null texts and texts without words have empty sets and are linked with nothing; fewer than five words are one shingle;
repeated rows share a component; ids may have any type with an order, a null id is no smallest id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import ship, stage
from waymark.llm.graph import components

#: Sketch size.
K = 64
WORDS = 5
#: Least Jaccard index, in percent.
PERCENT = 85
#: Lists of at most this many members give all their pairs at once.
SHORT = 24
#: Shingles of a long list that one task compares, about (twice as many for a pair of blocks).
BLOCK = 4_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_memo: dict[bytes, int] = {}


def shared_values(percent: int) -> int:
    """Sketch values that sets of this Jaccard index share: five standard deviations below the mean."""
    p = percent / 100
    return int(K * p - 5 * math.sqrt(K * p * (1 - p)))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (int64) of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_memo) > 400_000:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = xxhash.xxh3_64_intdigest(w)
    w = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = (h ^ (h >> np.uint64(29))) * _P + w[j : len(w) - size + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * _M
    h = (h ^ (h >> np.uint64(32))) * _M
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two halves of a hash of each set; null for empty sets."""
    halves = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
    none = np.array([not len(x) for x in sets], bool)
    return [pa.array(np.ascontiguousarray(halves[:, i]), mask=none) for i in (0, 1)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            batch = whole.slice(lo, 1024)
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            made = [pa.array([len(s) for s in sets], pa.int64()), *_keys(sets), pa.array([s[:K] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n", "c1", "c2", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            sets = [shingles(t) for t in whole.column(0).slice(lo, 1024).to_pylist()]
            yield pa.RecordBatch.from_arrays([*_keys(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c1", "c2", "full"])


def _exact(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(a, keep) if k], pa.int64()), pa.array([i for i, k in zip(b, keep) if k], pa.int64())], names=["a", "b"])


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(v, c, n): the inverted lists of two or more classes."""
    rows = classes.select("c", "n", F.explode("sketch").alias("v"))
    often = stage(rows.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1"), "near-often")
    held = rows.join(often, "v").groupBy("c").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("held"))
    size = F.least(F.col("n"), F.lit(K))
    full = F.col("n") * 100 <= K * percent  # its partners' sets fit into their sketches, too
    need = F.when(full, F.ceil(F.col("n") * percent / 100)).otherwise(shared_values(percent))
    keep = F.greatest(F.lit(0), F.size("held") - (need - 1)).cast("int")  # values of one class only come first and take their places
    chosen = held.select("c", "n", F.explode(F.slice("held", 1, keep)).alias("x")).select(F.col("x.v").alias("v"), "c", "n")
    chosen = stage(chosen, "near-chosen")
    return chosen.join(stage(chosen.groupBy("v").agg(F.count("*").alias("k")).filter("k > 1"), "near-sizes"), "v")


def _single_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns c, full to a row for each shingle."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["c", "s"])


class _Verifier:
    def __init__(self, docs: DataFrame, classes: DataFrame, lists: DataFrame, percent: int):
        self.percent, self.sketches = percent, classes.select("c", "sketch")
        need = classes.join(lists.select("c").distinct(), "c", "left_semi").select("c", "c1", "c2", "rep")
        texts = docs.join(need.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        sets = texts.mapInArrow(_full_sets, "c1 long, c2 long, full binary").dropDuplicates(["c1", "c2"])
        self.full = stage(sets.join(need, ["c1", "c2"]).select("c", "full"), "near-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes whose sets are alike enough."""
        of = lambda df, side, what: df.select(F.col("c").alias(side), F.col(what).alias(f"{what}_{side}"))
        est = pairs.join(of(self.sketches, "a", "sketch"), "a").join(of(self.sketches, "b", "sketch"), "b")
        union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, K)
        est = est.select("a", "b", F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)).alias("m"), F.size(union).alias("u"))
        likely = stage(est.filter(F.col("m") * K >= shared_values(self.percent) * F.col("u")).select("a", "b"), "near-likely")
        both = likely.join(of(self.full, "b", "full"), "b").join(of(self.full, "a", "full"), "a").select("a", "b", "full_a", "full_b")
        percent = self.percent
        return stage(both.mapInArrow(lambda it: _exact(it, percent), "a long, b long"), "near-links")


def _own(lists: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Long lists with ``u``, a class's shingles that no other class of them has; classes that this leaves no partner go."""
    classes = full.join(lists.select("c").distinct(), "c", "left_semi")
    single = classes.mapInArrow(_single_shingles, "c long, s long").groupBy("s").agg(F.count("*").alias("k"), F.max("c").alias("c")).filter("k = 1")
    rows = lists.join(single.groupBy("c").agg(F.count("*").alias("u")), "c", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    return rows.filter((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent)


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists with components; lists within one component are done and go."""
    rows = lists.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    apart = rows.groupBy("v").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.sum("n").alias("size")).filter("p <> q").select("v", "size")
    return rows.join(stage(apart, "near-apart"), "v")


def _pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one list, once each, whose sizes allow a link."""
    one, two = (short.select("v", F.col("c").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    fit = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return one.join(two, "v").filter(fit).select("a", "b").distinct()


class _Shared:
    """Shingles that a set shares with each of many others, through their inverted lists."""

    def __init__(self, sets: list[np.ndarray], n_values: int):
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner, self.many = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], len(sets)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=n_values))])

    def counts(self, values: np.ndarray) -> np.ndarray:
        first, size = self.ends[values], self.ends[values + 1] - self.ends[values]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=self.many)


class _Family:
    """Sets that meet in a task; ``links`` joins what the full sets join, without comparing all pairs."""

    def __init__(self, sets: list[np.ndarray], roots: list[int], percent: int):
        self.percent, self.far, self.parent = percent, 1 - percent / 100 + 1e-9, {r: r for r in roots}
        self.sizes, self.roots, self.out = np.array([len(x) for x in sets]), roots, []
        values, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum(self.sizes)
        self.n_values, self.sets = len(values), np.split(ids, ends[:-1])
        # the sets nearest to what most others hold come first: they lead, and the rest follows them
        self.order = np.argsort(-np.add.reduceat(often[ids], ends - self.sizes) / self.sizes, kind="stable").tolist()

    def find(self, r: int) -> int:
        while self.parent[r] != r:
            self.parent[r] = self.parent[self.parent[r]]
            r = self.parent[r]
        return r

    def apart(self, i: int, j: int) -> bool:
        return self.find(self.roots[i]) != self.find(self.roots[j])

    def join(self, i: int, j: int) -> None:
        p, q = self.find(self.roots[i]), self.find(self.roots[j])
        if p != q:
            self.parent[max(p, q)] = min(p, q)
            self.out.append((i, j))

    def distances(self, i: int, others: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of ``others``, and which are alike enough for a link."""
        union = self.sizes[i] + self.sizes[others] - shared
        return 1 - shared / union, 100 * shared >= self.percent * union

    def links(self) -> list[tuple[int, int]]:
        known, fresh, index = np.zeros(0, int), [], None  # leaders with and without an index
        led_by: dict[int, list[tuple[float, int]]] = {}
        for i in self.order:
            if index is None or len(fresh) >= 32:
                known = np.concatenate([known, np.array(fresh, int)])
                index, fresh = _Shared([self.sets[j] for j in known], self.n_values) if len(known) else None, []
            late = np.array(fresh, int)
            near = np.concatenate([index.counts(self.sets[i]) if index else known, [len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in fresh]]).astype(int)
            leaders = np.concatenate([known, late])
            d, alike = self.distances(i, leaders, near)
            hits = np.flatnonzero(alike)
            if not len(hits):
                led_by[i] = []
                fresh.append(i)
                continue
            led_by[int(leaders[hits[0]])].append((float(d[hits[0]]), i))
            for j in leaders[hits].tolist():
                self.join(i, j)
        if len({self.find(r) for r in self.roots}) > 1:
            self._between(np.array(list(led_by), int), led_by)
        return self.out

    def _between(self, leaders: np.ndarray, led_by: dict[int, list[tuple[float, int]]]) -> None:
        """Links of followers to other leaders and their followers.

        Leaders have met each other. A follower at distance d of a leader has no partner behind it that is nearer to that leader
        than d less the reach of a link.
        """
        index = _Shared([self.sets[j] for j in leaders], self.n_values)
        wide = np.array([max((d for d, _ in led_by[j]), default=0.0) for j in leaders.tolist()])
        for j in led_by:
            led_by[j].sort(reverse=True)
        for i in [i for mine in led_by.values() for _, i in mine]:
            d, alike = self.distances(i, leaders, index.counts(self.sets[i]))
            for at in np.flatnonzero(d <= self.far + wide).tolist():
                j = int(leaders[at])
                if not self.apart(i, j):
                    continue
                if alike[at]:
                    self.join(i, j)
                    continue
                for own, k in led_by[j]:
                    if d[at] - own > self.far or not self.apart(i, k):
                        break
                    shared = len(np.intersect1d(self.sets[i], self.sets[k], assume_unique=True))
                    if self.distances(i, np.array([k]), np.array([shared]))[1][0]:
                        self.join(i, k)


def _compare_families(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (v, i, j, c, root, full), ordered by (v, i, j), to links (a, b); a group may run over several batches."""
    held: list[tuple] = []
    last, out = None, []

    def close():
        if len(held) > 1:
            family = _Family([np.frombuffer(h[2], np.int64) for h in held], [h[1] for h in held], percent)
            out.extend((held[i][0], held[j][0]) for i, j in family.links())
        held.clear()

    def made():
        got = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        out.clear()
        return got

    for batch in batches:
        for v, i, j, *rest in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if (v, i, j) != last:
                close()
                last = (v, i, j)
            held.append(tuple(rest))
        yield made()
    close()
    yield made()


def _blocks() -> Column:
    return F.ceil(F.col("size") / BLOCK)


def _met(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links among the rows (v, i, j, c, root) of each group (v, i, j)."""
    rows = rows.select("v", "i", "j", "c", "root").join(full, "c").select("v", "i", "j", "c", "root", "full")
    rows = rows.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    return stage(rows.mapInArrow(lambda it: _compare_families(it, percent), "a long, b long"), "near-long-links")


def _within(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links within each block of long lists (v, c, n, root, size)."""
    m = F.pmod(F.xxhash64("c"), _blocks())
    return _met(rows.withColumn("i", m).withColumn("j", m), full, percent)


def _across(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between blocks of long lists, by list and pair of blocks."""
    rows = rows.withColumn("m", F.pmod(F.xxhash64("c"), _blocks())).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), _blocks() - 1))).filter("m <> o")
    return _met(rows.withColumn("i", F.least("m", "o")).withColumn("j", F.greatest("m", "o")), full, percent)


def _long_links(lists: DataFrame, links: DataFrame, roots: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links and the components after the long lists ``lists`` (v, c, n)."""
    seen = {"links": links, "roots": roots}

    def more(found: DataFrame) -> None:
        if found.limit(1).count():
            seen["links"] = seen["links"].unionByName(found)
            seen["roots"] = components(seen["links"])

    rows = stage(_own(_open(lists, roots), full, percent), "near-long")
    more(_within(rows, full, percent))
    wide = rows.filter(_blocks() > 1).select("v", "c", "n")
    if not wide.limit(1).count():
        return seen["links"], seen["roots"]
    rows = stage(_open(wide, seen["roots"]), "near-long")
    one = rows.groupBy("v", "root").agg(F.min("c").alias("c")).join(lists.select("v", "c", "n"), ["v", "c"])
    more(_within(_open(one.select("v", "c", "n"), seen["roots"]), full, percent))
    rows = stage(_open(wide, seen["roots"]), "near-long")
    if rows.limit(1).count():
        more(_across(rows, full, percent))
    return seen["links"], seen["roots"]


def near_dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept, a row for each document."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()))
    shape = T.StructType([docs.schema["doc_id"], *(T.StructField(n, k) for n, k in zip(("n", "c1", "c2", "sketch"), kinds))])
    sets = stage(docs.mapInArrow(_sketches, shape), "near-sketch")
    classes = sets.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stage(classes.withColumn("c", F.monotonically_increasing_id()), "near-classes")
    lists = stage(_lists(classes, percent), "near-lists")
    verify = _Verifier(docs, classes, lists, percent)
    links = verify.links(_pairs(lists.filter(F.col("k") <= SHORT), percent))
    roots = components(links)
    long = lists.filter(F.col("k") > SHORT).select("v", "c", "n")
    links, roots = _long_links(long, links, roots, verify.full, percent)
    named = classes.select("c", "c1", "c2", "rep").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(named.join(lowest, "root").select("c1", "c2", "component_id"), "near-named")
    done = sets.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2").join(named, ["c1", "c2"], "left")
    done = done.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return done.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
