"""Benchmark decontamination (operator 2).

Words are runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``n`` consecutive words of a
benchmark item (a shorter item is one window). A document word inside any occurrence of a window is hit.

While the benchmark stays within ``max_words`` words and ``MAX_BYTES`` bytes (checked with one aggregate), its windows are broadcast as a hash set:
each document is scanned where it lies, candidate windows found by a rolling hash are verified word by word, and nothing is
shuffled. A larger benchmark takes the join path: document windows meet item windows on their text, keyed by hash.

Cases: null text has no words and no hits; an item without words has no window; items with one id count as one, items without an
id as one null at the end of ``items``; repeated documents each count on their own row; an empty table gives an empty result, an
empty benchmark hits nothing; extra columns are ignored unless named in ``keep``, clashing result names get an underscore.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import column_names, lower_az, ship

#: Benchmarks of more words than this are joined, not broadcast (about 200 MB of window tables in each Python worker).
MAX_WORDS = 1_000_000
#: And bytes of all texts that have a word.
MAX_BYTES = 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and blanks every ASCII byte outside 0-9 and a-z; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _nulls_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class Windows:
    """Windows of the benchmark by length: rolling hashes for the scan, exact word ids for the check."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.ids: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items}, key=_nulls_last)
        at = {i: k for k, i in enumerate(self.items)}
        self.exact: dict[int, dict[tuple, set[int]]] = {}
        for item, words in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            size = min(n, len(seq))
            for i in range(len(seq) - size + 1) if size else ():
                self.exact.setdefault(size, {}).setdefault(tuple(seq[i : i + size]), set()).add(at[item])
        self.bits = {}
        for size, known in self.exact.items():
            hashes = self.roll(np.array([x for w in known for x in w], np.uint64).reshape(-1, size))
            self.bits[size] = np.zeros(1 << 22, bool)
            self.bits[size][hashes] = True

    @staticmethod
    def roll(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = h * _MULT + rows[:, j]
        return (h * _MULT) >> np.uint64(42)

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, set[int]]:
        """Number of words, hit mask (None: no hit) and positions of items whose windows occur."""
        words = words_of(text)
        get = self.ids.get
        seq = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        mask, found = None, set()
        for size, known in self.exact.items():
            if len(seq) < size:
                continue
            view = np.lib.stride_tricks.sliding_window_view(seq, size)
            for i in np.flatnonzero(self.bits[size][self.roll(view)]).tolist():
                if (got := known.get(tuple(view[i].tolist()))) is not None:
                    mask = np.zeros(len(seq), bool) if mask is None else mask
                    mask[i : i + size] = True
                    found |= got
        return len(words), mask, found


_built: dict[str, Windows] = {}


def _windows(key: str, items, n: int) -> Windows:
    """The windows of a broadcast benchmark, built once a worker for a scan."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows([(i, words_of(t)) for i, t in items.value], n)
    return _built[key]


def _spans(mask: np.ndarray | None) -> list[list[int]]:
    if mask is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: list[str] | None = None, max_words: int = MAX_WORDS, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus n_words, n_hit, items (sorted as strings) and spans ([start, end) word positions of hits).

    A result column whose name is taken gets an underscore.
    """
    keep = ["doc_id"] if keep is None else keep
    worded = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t"), F.regexp_count(lower_az("text"), F.lit(WORD)).alias("n")).filter("n > 0")
    total = worded.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if total[0] > max_words or total[1] > MAX_BYTES:
        return _joined(docs, benchmark, n, keep, text_col)
    ship(docs.sparkSession)
    items = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in worded.select("item", "t").collect()])
    key = uuid.uuid4().hex
    base = docs.select(*keep)
    extra = list(zip(_names(base), (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.ArrayType(T.IntegerType())))))
    schema = T.StructType([*base.schema.fields, *(T.StructField(a, b) for a, b in extra)])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            windows = _windows(key, items, n)
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                got = [windows.scan(t) for t in batch.column(k).to_pylist()]
                made = [
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([0 if g[1] is None else int(g[1].sum()) for g in got], pa.int64()),
                    pa.array([sorted((windows.items[i] for i in g[2]), key=_nulls_last) for g in got], pa.list_(pa.string())),
                    pa.array([_spans(g[1]) for g in got], pa.list_(pa.list_(pa.int32()))),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], names=[*batch.schema.names[:k], *(a for a, _ in extra)])

    (text,) = column_names(base, "text_in")
    return docs.select(*keep, docs[text_col].alias(text)).mapInArrow(run, schema)


def _names(df: DataFrame) -> list[str]:
    return column_names(df, "n_words", "n_hit", "items", "spans")


def _joined(docs: DataFrame, benchmark: DataFrame, n: int, keep: list[str], text_col: str) -> DataFrame:
    """The same result by an equi-join of windows, for a benchmark too large to broadcast. Rows alike in all kept columns and text share one scan."""
    words = lambda c: F.regexp_extract_all(lower_az(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    cut = lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    item = item.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), F.explode(cut(F.least(F.size("w"), F.lit(n)))).alias("win"))
    item = item.groupBy("len", "win").agg(F.collect_set(F.struct("item")).alias("its"))  # as structs, else a null id would be lost
    lens = [r[0] for r in item.select("len").distinct().collect()]  # n numbers at most
    kept, names = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], _names(docs.select(*keep))
    key = F.sha2(F.to_json(F.struct(*kept, F.col(text_col).alias("t"))), 256)
    rows = docs.select(*kept, F.col(text_col).alias("t"), key.alias("k"))
    once = rows.groupBy("k").agg(F.first("t").alias("t")).select("k", words(F.col("t")).alias("w"))
    hits = None
    for size in lens:
        at = once.filter(F.size("w") >= size).select("k", F.lit(size).alias("len"), F.posexplode(cut(F.lit(size))).alias("pos", "win"))
        hits = at if hits is None else hits.unionByName(at)
    if hits is None:
        hits = once.select("k", F.lit(0).alias("len"), F.lit(0).alias("pos"), F.lit("").alias("win")).limit(0)
    hits = hits.join(item, ["len", "win"]).select("k", "pos", (F.col("pos") + F.col("len")).alias("end"), "its")
    w = Window.partitionBy("k").orderBy("pos", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("run", F.sum(F.when(F.col("pos") <= far, 0).otherwise(1)).over(w))
    runs = hits.groupBy("k", "run").agg(F.min("pos").alias("a"), F.max("end").alias("b"), F.array_distinct(F.flatten(F.collect_set("its"))).alias("its"))
    per = runs.groupBy("k").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("its"))), lambda x: x["item"])).alias("items"), F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), lambda s: F.array(s["a"], s["b"])).alias("spans"))
    done = rows.withColumn("n_words", F.size(words(F.col("t"))).cast("long")).join(per, "k", "left")
    values = (F.col("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<array<int>>")))
    return done.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(v.alias(n) for v, n in zip(values, names)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents without a hit word, with the columns they came with."""
    found = scan(docs, benchmark, n, docs.columns, max_words)
    return found.filter(F.col(found.columns[-3]) == 0).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """All documents, each hit span of words (with what lies between them) cut out of the text; n_chars follows if it is there."""
    ship(docs.sparkSession)
    found = scan(docs, benchmark, n, docs.columns, max_words)

    @F.pandas_udf("string")
    def cut(text, spans):
        import re

        import pandas as pd

        word, out = re.compile(WORD), []
        for t, ss in zip(text, spans):
            if t is not None and len(ss):
                at = [m.span() for m in word.finditer(t.translate({c: c + 32 for c in range(65, 91)}))]
                for a, b in sorted(map(tuple, ss), reverse=True):
                    t = t[: at[a][0]] + t[at[b - 1][1] :]
            out.append(t)
        return pd.Series(out)

    found = found.withColumn("text", F.when(F.col(found.columns[-3]) > 0, cut("text", found.columns[-1])).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*docs.columns)
