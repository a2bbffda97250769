"""Toxicity by maximum-scoring segments (operator 8).

Words and their beginnings get log-odds between toxic and other texts under a Dirichlet prior (the pooled distribution, each
word once a document); a word scores by its most telling feature, and words that do not differ significantly drift slightly below zero. A linear scan finds all maximal scoring segments of a text. Their scores are
judged by extreme-value statistics: lambda solves sum p(w) exp(lambda s(w)) = 1 under the background of other texts, K is
fitted on held-back background texts, and the best sum over the r highest segments, lambda S - r ln(K n) + ln r!, is the
text's statistic. A logistic curve, fitted on the held-back rows, turns it into a probability.

The model is fitted on at most ``SAMPLE`` labelled rows of each class, the first by a hash of the id; only their ids reach the
driver. Tokens fall into 2**18 buckets, so the model has a fixed size. Scoring reads each text where it lies; no shuffle.

Cases: null and empty texts get the score of a text without evidence; without labels of both classes every score is the share
of label 1 (0.5 without any); a document with several labels counts as toxic if one says so; null labels are left out;
labels of unknown documents count for nothing; ids may have any type, those of the labels are read as that; repeated rows get
equal scores; an empty table gives an empty result; extra columns pass through ``keep``, clashing result names get an underscore.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import column_names, ship

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 25_000
BITS = 18
_MASK = (1 << BITS) - 1
#: Beginnings of a word that are features too, in bytes: stems with many endings share evidence.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Prior strength as a share of the pooled counts, the z value from which a token counts as different, the drift of the others, segments summed at most.
PRIOR, SIGNIFICANT, DRIFT, MOST = 0.1, 3.0, 0.05, 8
#: A passage is significant if fewer than this many such are expected by chance in a text of this length.
EXPECTED = 0.05
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()


def features(word: bytes) -> list[int]:
    """Buckets of the word and of its beginnings."""
    return [zlib.crc32(word) & _MASK, *(zlib.crc32(b"^" + word[:n]) & _MASK for n in BEGINNINGS if n < len(word))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), in linear time: a stack of candidates with the sums before and after each."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, sum before, sum after, nearest earlier candidate with a smaller sum before
    for i in up.tolist():
        one = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= one[3]:
                one[4] = j
                stack.append(one)
                break
            one[0], one[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


class Model:
    def __init__(self, toxic: np.ndarray, other: np.ndarray):
        self.base, self.slope, self.shift, self.k, self.lam = 0.5, 0.0, 0.0, 1.0, 1.0
        both, n1, n0 = toxic + other, toxic.sum(), other.sum()
        self.odds, self.z = np.zeros(1 << BITS), np.zeros(1 << BITS)
        if n1 and n0:
            prior = PRIOR * np.maximum(both, 0.5)
            y1, y0, m1, m0 = toxic + prior, other + prior, n1 + prior.sum(), n0 + prior.sum()
            self.odds = np.log(y1 / (m1 - y1)) - np.log(y0 / (m0 - y0))
            self.z = np.where(both > 0, self.odds / np.sqrt(1 / y1 + 1 / y0), 0)
        self.memo: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def word_score(self, word: bytes) -> float:
        """Log-odds of the word's most telling feature, or the drift."""
        at = max(features(word), key=lambda i: abs(self.z[i]))
        return float(self.odds[at]) if self.z[at] >= SIGNIFICANT else max(float(self.odds[at]), -2.0) - DRIFT if self.z[at] <= -SIGNIFICANT else -DRIFT

    def scores(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > 500_000:
            self.memo.clear()
        for w in set(words).difference(self.memo):
            self.memo[w] = self.word_score(w)
        return np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words))

    def fit_lambda(self, s: np.ndarray, n: np.ndarray) -> None:
        """From the scores of background words and their counts; the highest score counts as half seen, else it would prove too much."""
        top = float(self.odds[self.z >= SIGNIFICANT].max(initial=0.0))
        s, n = np.append(s, top), np.append(n, 0.5)
        p = n / n.sum()
        f = lambda x: float((p * np.exp(np.minimum(x * s, 500))).sum()) - 1
        if (s * p).sum() >= 0 or s.max() <= 0:
            return
        lo, hi = 1e-6, 1.0
        while f(hi) < 0 and hi < 1e3:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        self.lam = hi

    def statistic(self, found: list[tuple[int, int, float]], n: int) -> float:
        best, total, space = -math.log(self.k * max(n, 1)), 0.0, math.log(self.k * max(n, 1))
        for r, s in enumerate(sorted((x[2] for x in found), reverse=True)[:MOST], 1):
            total += s
            best = max(best, self.lam * total - r * space + math.lgamma(r + 1))
        return best

    def judge(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        found, n = segments(self.scores(words)), max(len(words), 1)
        x = min(max(self.slope * min(max(self.statistic(found, n), -30), 30) + self.shift, -30), 30)
        p = 1 / (1 + math.exp(-x)) if self.slope else self.base
        return p, [s for s in found if self.k * n * math.exp(-self.lam * s[2]) <= EXPECTED]


def _sample(labels: DataFrame, most: int) -> dict:
    """Toxic flag by id of at most ``most`` rows of each class."""
    one = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    return {r[0]: v for v in (0, 1) for r in one.filter(F.col("toxic") == v).select("doc_id").orderBy(order, "doc_id").limit(most).collect()}


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType
    sample = spark.sparkContext.broadcast(_sample(labels.select(F.col("doc_id").try_cast(kind).alias("doc_id"), "toxic"), most))
    share = sum(sample.value.values()) / max(1, len(sample.value))
    ids = spark.createDataFrame([(i,) for i in sample.value], T.StructType([T.StructField("doc_id", kind)]))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # 2 x most ids at most
    held_back = lambda i: zlib.crc32(f"fit{i}".encode()) % 3 == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())  # a word counts once a document: repetition says nothing more
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_back(i):
                    seen[sample.value[i]].update(set(words_of(t)))
            for v in (0, 1):
                for word, n in seen[v].items():
                    for at in features(word):
                        held[v, at] += n
        for v in (0, 1):
            at = np.flatnonzero(held[v])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), pa.array(at.astype(np.int32)), pa.array(held[v][at])], names=["toxic", "bucket", "n"])

    counts = np.zeros((2, 1 << BITS))
    for r in rows.mapInArrow(count, "toxic int, bucket int, n long").groupBy("toxic", "bucket").agg(F.sum("n")).toLocalIterator():
        counts[r[0], r[1]] = r[2]
    model = Model(counts[1], counts[0])
    model.base = share if sample.value else 0.5
    if not counts[0].any() or not counts[1].any():
        return model
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each held-back document (n words, best segments), and rows of toxic = -1: a score and its words in other texts."""
        out, common = [], Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held_back(i):
                    s = shared.value.scores(words_of(t))
                    out.append((sample.value[i], len(s), sorted((x[2] for x in segments(s)), reverse=True)[:MOST]))
                    if not sample.value[i]:
                        at, n = np.unique(np.round(s, 2), return_counts=True)
                        common.update(dict(zip(at.tolist(), n.tolist())))
        out += [(-1, n, [s]) for s, n in common.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["toxic", "n", "top"])

    got = rows.mapInArrow(measure, "toxic int, n long, top array<double>").collect()  # a third of the sample, and a few hundred scores a task
    seen = [r for r in got if r["toxic"] >= 0]
    spread = [r for r in got if r["toxic"] < 0]
    model.fit_lambda(np.array([r["top"][0] for r in spread]), np.array([r["n"] for r in spread], float))
    spaces = [max(1, r["n"]) * math.exp(-model.lam * max(r["top"], default=0.0)) for r in seen if r["toxic"] == 0]
    model.k = len(spaces) / sum(spaces) if spaces else 1.0
    x = np.array([model.statistic([(0, 0, s) for s in r["top"]], r["n"]) for r in seen])
    y = np.array([r["toxic"] for r in seen], float)
    if len(set(y)) == 2:
        model.slope, model.shift = _logistic(np.clip(x, -30, 30), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the best logistic curve, with a slight pull towards zero slope."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - np.array([1e-3, 0]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-9), float(w[1])


def score(docs: DataFrame, model: Model, keep: list[str | Column] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus score (0 to 1) and segments: the significant passages as word positions [start, end) with scores."""
    ship(docs.sparkSession)
    chosen = docs.columns if keep is None else keep
    base = docs.select(*chosen)
    names, k = column_names(base, "score", "segments"), len(base.columns)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*base.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], kind)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.judge(words_of(t)) for t in batch.column(k).to_pylist()]
            made = [pa.array([g[0] for g in got], pa.float64()), pa.array([[dict(zip(("start", "end", "score"), s)) for s in g[1]] for g in got], arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], names=[*batch.schema.names[:k], *names])

    (text,) = column_names(base, "text_in")
    return docs.select(*chosen, docs[text_col].alias(text)).mapInArrow(run, schema)
