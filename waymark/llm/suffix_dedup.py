"""Suffix-array dedup by deep-shallow sorting (operator 5).

Removes each byte that is covered by a ``LENGTH``-byte string which also starts anywhere else; matches do not cross texts.

1. Texts are scanned for anchors: the leftmost smallest ``GRAM``-byte window hash among those inside each ``LENGTH``-byte string.
   Equal strings have equal anchors at equal offsets, so every repeat shows at a pair of anchors with equal grams. Copies of a
   whole text (equal in 128 bits of hash and in length) enter once; their number is kept.
2. Grams that occur once are dropped by a count. An anchor's context is the bytes around it that a repeat can reach. Before they
   are shuffled, contexts are thinned to two of each, found by 128 bits of hash: two are enough to show that it repeats.
3. The contexts of a gram, equal ones included, are sorted by what follows and by what precedes the anchor: multikey quicksort on
   eight-byte words to a shallow depth, then blind tries for groups that are still equal there. From the two orders with their
   common-prefix lengths follow the longest repeat that reaches left and the longest that reaches right; together one span.
   Bytes decide here, for contexts of different texts as for those of one.
4. Spans are merged per text and cut out.

A gram that still has more than ``GROUP`` contexts is not gathered in a task; the exact way for these: all strings around its anchors are
counted by digest, with a partial aggregate and an equi-join back, which gives the same spans. Counts and sets that meet large
tables are written first, so that adaptive execution may split hot keys in the joins. Rounds are written to the shared folder.

Cases: null text counts as empty; texts shorter than ``LENGTH`` lose nothing; repeated rows are copies of each other and lose
everything from ``LENGTH`` bytes on; an empty table gives an empty result; extra columns are ignored unless named in ``keep``,
clashing result names get an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import column_names, ship, stage

LENGTH, GRAM = 400, 120
#: Contexts of a gram that one task sorts, at most.
GROUP = 20_000
#: Depth of the quicksort in eight-byte words; groups of this size or less go to the blind trie at once.
SHALLOW, FEW = 4, 8
#: Up to this many occurrences are compared through a matrix, more through classes at each offset.
MATRIX = 48
_CHUNK = 1 << 19
_PRIME = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        for p in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            out[1:] = p
            _powers.setdefault(size, ())
            _powers[size] += (np.cumprod(out),)
    return _powers[size]


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of a text's anchors."""
    at, hashes = [], []
    for lo in range(0, max(1, len(data) - length + 1), _CHUNK):
        p, h = _anchors(np.frombuffer(data, np.uint8)[lo : lo + _CHUNK + length - 1], length, gram)
        at.append(p + lo)
        hashes.append(h)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, hashes[first]


def _anchors(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    if len(b) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(b) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    n, w = len(h), length - gram + 1
    key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
    # sliding minimum: blocks of w, minima from the left and from the right
    size = -(-n // w) * w
    full = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    left = np.minimum.accumulate(full.reshape(-1, w), axis=1).ravel()
    right = np.minimum.accumulate(full.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - w + 1], left[w - 1 : n])
    at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at].view(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(texts: list[bytes], idx: list[int]) -> list[int]:
    """``idx`` in the order of its texts. A node holds a depth and its children by the byte there (-1: the text ends)."""
    leaf = lambda i: (None, [i])
    byte = lambda i, d: texts[i][d] if d < len(texts[i]) else -1
    root = leaf(idx[0])
    for i in idx[1:]:
        node = root
        while node[0] is not None:  # blindly: skip to any leaf below
            kids = node[1]
            node = kids.get(byte(i, node[0])) or next(iter(kids.values()))
        d = common(texts[i], texts[node[1][0]])
        if d == len(texts[i]) == len(texts[node[1][0]]):
            node[1].append(i)
            continue
        above, node = None, root
        while node[0] is not None and node[0] < d:
            above, node = node, node[1][byte(i, node[0])]
        if node[0] == d:
            node[1][byte(i, d)] = leaf(i)
            continue
        any_leaf = node
        while any_leaf[0] is not None:
            any_leaf = next(iter(any_leaf[1].values()))
        fork = (d, {byte(any_leaf[1][0], d): node, byte(i, d): leaf(i)})
        if above is None:
            root = fork
        else:
            above[1][byte(i, above[0])] = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[0] is None:
            out += node[1]
        else:
            todo += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow(texts: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Order of the texts, and the common-prefix length of each with the one before it (0 for the first)."""
    out: list[int] = []
    if len(texts) <= FEW:
        out = blind_trie(texts, list(range(len(texts))))
    else:
        width = SHALLOW * 8
        words = np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in texts), ">u8").reshape(-1, SHALLOW)
        todo = [(np.arange(len(texts)), 0)]
        while todo:
            idx, depth = todo.pop()
            if depth >= SHALLOW or len(idx) <= FEW:
                if len(idx):
                    out += blind_trie(texts, idx.tolist())
                continue
            key = words[idx, depth]
            pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
            # the stack gives the smaller keys back first
            todo += [(idx[key > pivot], depth), (idx[key == pivot], depth + 1), (idx[key < pivot], depth)]
    lcp = np.zeros(len(out), np.int64)
    for i in range(1, len(out)):
        lcp[i] = common(texts[out[i - 1]], texts[out[i]])
    return out, lcp


def _matrix(order: list[int], lcp: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of all pairs of a small group."""
    n = len(order)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        run = np.minimum.accumulate(lcp[i + 1 :])
        out[order[i], order[i + 1 :]] = run
        out[order[i + 1 :], order[i]] = run
    return out


def reach(before: list[bytes], after: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeats around each occurrence of a gram reach left and right of it; (-1, -1) without a repeat.

    ``before``: the preceding bytes, backwards; ``after``: the gram and what follows. Only pairs that agree on the whole gram count.
    """
    n = len(before)
    left, right = np.full(n, -1), np.full(n, -1)
    if n == 2:
        a, b = common(*before), common(*after)
        if b >= gram and a + b >= length:
            left[:], right[:] = a, b
        return left, right
    (o1, l1), (o2, l2) = deep_shallow(before), deep_shallow(after)
    if n <= MATRIX:
        a, b = _matrix(o1, l1), _matrix(o2, l2)
        ok = (b >= gram) & (a + b >= length)
        np.fill_diagonal(ok, False)
        return np.where(ok, a, -1).max(1), np.where(ok, b, -1).max(1)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    sizes1, sizes2 = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    for t in range(length - gram + 1):  # strings that begin t bytes before the gram
        a[o1], b[o2] = np.cumsum(l1 < t), np.cumsum(l2 < length - t)
        ok = (sizes1 >= t) & (sizes2 >= length - t)
        at = np.flatnonzero(ok)
        _, inverse, many = np.unique(a[at] * (n + 1) + b[at], return_inverse=True, return_counts=True)
        hit = at[many[inverse] > 1]
        left[hit] = np.maximum(left[hit], t)
        right[hit] = np.maximum(right[hit], length - t)
    return left, right


def _scan(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Columns h1, h2, t to h1, h2, len and anchors: position, gram hash, two halves of the context's hash."""
    reach_left = length - gram
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            texts = batch.column(2).to_pylist()
            got = [anchors(t, length, gram) for t in texts]
            x = b"".join(xxhash.xxh3_128_digest(t[max(0, i - reach_left) : i + length], seed=min(i, reach_left)) for t, (p, _) in zip(texts, got) for i in p.tolist())
            halves = np.frombuffer(x, np.int64).reshape(-1, 2)
            parts = (np.concatenate([p for p, _ in got]).astype(np.int32), np.concatenate([h for _, h in got]), halves[:, 0], halves[:, 1])
            ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in got])]).astype(np.int32)
            spots = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in parts], names=["at", "g", "x1", "x2"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int32()), spots], names=["h1", "h2", "len", "anchors"])


_KEYS = ("g", "x1", "x2")


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Columns t, spots to a row for each spot: its keys, the preceding bytes backwards, the gram and what follows."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 128):
            batch = whole.slice(lo, 128)
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, spots in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for s in spots:
                    at = s["at"]
                    for col, v in zip(out, (*(s[k] for k in _KEYS), text[max(0, at - length + gram) : at][::-1], text[at : at + length])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.binary(),) * 2)], names=[*_KEYS, "before", "after"])


def _sort_groups(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts ordered by gram to (g, x1, x2, l, r), how far repeats reach, a row for each different context; a group may run over several batches."""
    keys, before, after = [], [], []
    out: tuple[list, ...] = ([], [], [], [], [])

    def close():
        if len(keys) > 1:
            left, right = reach(before, after, length, gram)
            found = {keys[i]: (int(left[i]), int(right[i])) for i in np.flatnonzero(left >= 0).tolist()}
            for key, reached in found.items():
                for col, v in zip(out, (*key, *reached)):
                    col.append(v)
        for held in (keys, before, after):
            held.clear()

    def made():
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.int32(),) * 2)], names=[*_KEYS, "l", "r"])
        for col in out:
            col.clear()
        return got

    for batch in batches:
        for *key, b, a in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if keys and key[0] != keys[0][0]:
                close()
            keys.append(tuple(key))
            before.append(b)
            after.append(a)
        yield made()
    close()
    yield made()


def _cut(data: bytes, spans: list, n_copies: int, length: int) -> tuple[int, int, int, bytes]:
    if n_copies > 1 and len(data) >= length:
        return len(data), len(data), 1, b""
    kept, at, runs = [], 0, 0
    for s in sorted((s["a"], s["b"]) for s in spans):
        if s[0] > at or not runs:
            kept.append(data[at : s[0]])
            runs += 1
        at = max(at, s[1])
    kept.append(data[at:])
    left = b"".join(kept)
    return len(data), len(data) - len(left), runs, left


def _hashes(data: Column) -> tuple[Column, Column]:
    return F.xxhash64(data).alias("h1"), F.xxhash64(F.lit("second"), data).alias("h2")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, text_col: str = "text") -> DataFrame:
    """(h1, h2, len, n, spans): by text, its number of copies and the byte spans [a, b) that repeats cover; texts without either are left out."""
    ship(docs.sparkSession)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(*_hashes(data), data.alias("t")).filter(F.octet_length("t") >= length)
    shape = "h1 long, h2 long, len int, anchors array<struct<at:int,g:long,x1:long,x2:long>>"
    scanned = texts.mapInArrow(lambda it: _scan(it, length, gram), shape).groupBy("h1", "h2", "len").agg(F.count("*").alias("n"), F.first("anchors").alias("anchors"))
    known = stage(scanned.withColumn("tid", F.monotonically_increasing_id()), "suffix-anchors")
    found = known.select("tid", "len", F.inline("anchors"))
    often = stage(found.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "suffix-grams")
    spots = stage(found.join(often, "g"), "suffix-spots")
    sets = stage(spots.groupBy(*_KEYS).agg(F.min(F.struct("tid", "at")).alias("lo"), F.max(F.struct("tid", "at")).alias("hi")), "suffix-sets")
    need = sets.select(*_KEYS, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("one")).select(F.col("one.tid").alias("tid"), F.struct(F.col("one.at").alias("at"), *_KEYS).alias("s"))
    need = need.groupBy("tid").agg(F.collect_list("s").alias("spots")).join(known.select("tid", "h1", "h2"), "tid")
    around = texts.dropDuplicates(["h1", "h2"]).join(need, ["h1", "h2"]).select("t", "spots")
    around = around.mapInArrow(lambda it: _contexts(it, length, gram), "g long, x1 long, x2 long, before binary, after binary")
    sizes = sets.groupBy("g").agg(F.sum(F.when(F.col("lo") == F.col("hi"), 1).otherwise(2)).alias("rows"))
    hot, counted = stage(sizes.filter(F.col("rows") > group).select("g"), "suffix-hot"), None
    if hot.limit(1).count():
        around = stage(around, "suffix-contexts")
        counted, around = _by_digest(around.join(hot, "g"), length), around.join(hot, "g", "left_anti")
    reached = around.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _sort_groups(it, length, gram), "g long, x1 long, x2 long, l int, r int")
    reached = stage(reached if counted is None else reached.unionByName(counted), "suffix-reached")
    spans = spots.join(reached, [*_KEYS]).select("tid", (F.col("at") - F.col("l")).alias("a"), (F.col("at") + F.col("r")).alias("b"))
    spans = spans.groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return stage(known.select("tid", "h1", "h2", "len", "n").join(spans, "tid", "left").filter("n > 1 or spans is not null").drop("tid"), "suffix-spans")


def _by_digest(around: DataFrame, length: int) -> DataFrame:
    """Reach of repeats around hot grams: every string around an anchor is counted by its digest over all contexts."""
    forward = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex("before"), F.lit(".."), F.lit(0))), ""))
    whole = around.select(*_KEYS, F.octet_length("before").alias("k"), F.concat(forward, F.col("after")).alias("t"))
    starts = F.sequence(F.lit(0), F.least(F.col("k"), F.octet_length("t") - length))
    strings = whole.filter(F.octet_length("t") >= length).select(*_KEYS, "k", "t", F.explode(starts).alias("i")).select(*_KEYS, (F.col("k") - F.col("i")).alias("l"), F.md5(F.substring("t", F.col("i") + 1, F.lit(length))).alias("s"))
    often = stage(strings.groupBy("g", "l", "s").agg(F.count("*").alias("n")).filter("n > 1").select("g", "l", "s"), "suffix-strings")
    return strings.join(often, ["g", "l", "s"]).groupBy(*_KEYS).agg(F.max("l").alias("l"), (F.lit(length) - F.min("l")).cast("int").alias("r"))


def suffix_dedup(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``keep`` columns plus n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the remaining bytes as ``kept``."""
    keep = [id_col] if keep is None else keep
    spans = repeated_spans(docs, length, gram, group, text_col)
    base = docs.select(*keep)
    names = column_names(base, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType()] + [T.BinaryType()] * with_text
    schema, k = T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds))]), len(keep)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), data.alias("t"), *_hashes(data), F.octet_length(data).alias("len")).join(spans, ["h1", "h2", "len"], "left").select(*(f"k{i}" for i in range(k)), "t", "spans", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                got = [_cut(t, s or [], n or 1, length) for t, s, n in zip(*(batch.column(k + i).to_pylist() for i in range(3)))]
                made = [*(pa.array([g[i] for g in got], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(g[3]).hexdigest() for g in got])] + ([pa.array([g[3] for g in got], pa.binary())] if with_text else [])
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], names=[*(f.name for f in schema.fields)])

    return rows.mapInArrow(run, schema)
