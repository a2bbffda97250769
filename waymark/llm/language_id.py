"""Language identification by error-correcting output codes (operator 3).

Every language has a codeword of bits. For each bit a binary byte-trigram classifier (log-odds between the mean trigram
distributions of the languages on either side) predicts it; a text goes to the language whose codeword has the least
weighted logistic loss against the predicted margins. A bit weighs for a language what it separates on average there.

Trigram counts come from all training rows, added up within a partition first, so what is shuffled is one row per
(partition, language, bucket). The model holds languages x 16,384 numbers; more than ``MOST_LANGUAGES`` values of the language
column raise an error, as that is no language column. Predictions read each text where it lies; no
shuffle. Up to six languages get the exhaustive code, more get a seeded random code.

Cases: null texts and texts without a letter give ``und`` with score 0 and count as ambiguous; without training rows every
text does; one language alone is always predicted; ties go to the first language by name; repeated rows count repeatedly in
training; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import column_names, ship

BITS = 14
UNKNOWN = "und"
#: Best and second language closer than this in probability: ambiguous.
AMBIGUOUS = 0.2
#: Languages of a model, at most (64 MB of counts on the driver).
MOST_LANGUAGES = 512
#: Trigrams that count in full towards certainty.
FULL_GRAMS = 60
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased letters, words parted by one blank."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def codewords(k: int) -> np.ndarray:
    """(k, bits) of +1 and -1, all rows and columns different, no column constant."""
    if k <= 6:
        rest = [c for c in product((1, -1), repeat=k - 1) if -1 in c]
        return np.array([(1, *c) for c in rest], np.float32).T.reshape(k, -1)
    rng, columns = np.random.default_rng(11), {}
    while len(columns) < np.ceil(10 * np.log2(k)) or len(np.unique(np.array(list(columns)), axis=1).T) < k:
        column = (1, *rng.choice((-1, 1), k - 1).tolist())
        if -1 in column:
            columns[column] = True
    return np.array(list(columns), np.float32).T


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        if len(self.langs) > 1:
            raw = np.stack([counts[x] for x in self.langs]).astype(np.float64) + 0.5
            p = raw / raw.sum(1, keepdims=True)
            self.code = codewords(len(self.langs))
            side = lambda s: np.stack([p[self.code[:, b] == s].mean(0) for b in range(self.code.shape[1])], 1)
            self.odds = (np.log(side(1)) - np.log(side(-1))).astype(np.float32)
            gain = np.maximum((p @ self.odds) * self.code, 1e-6)
            self.weight = gain / gain.sum(1, keepdims=True)
            self.scale = 1 / max(1e-9, float(gain.mean()))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        h = grams(text)
        if not len(h):
            h = np.zeros(1, np.int64)
        margin = self.odds[h].mean(0) * self.scale
        loss = (np.logaddexp(0, -self.code * margin) * self.weight).sum(1)
        p = np.exp((loss.min() - loss) * 8 * min(1.0, len(h) / FULL_GRAMS))
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] - np.partition(p, -2)[-2] < AMBIGUOUS)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of all rows whose language is not null."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in held:
                    if len(held) >= 64:
                        yield from rows()
                        held.clear()
                    held[lang] = np.zeros(1 << BITS, np.int64)
                if len(h := grams(text or "")):
                    held[lang] += np.bincount(h, minlength=1 << BITS) if len(h) > 2000 else 0
                    if len(h) <= 2000:
                        np.add.at(held[lang], h, 1)
        yield from rows()

    some = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    if (kinds := some.select("l").distinct().limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {kinds - 1} values; a model holds {MOST_LANGUAGES} languages at most")
    total = some.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in total.toLocalIterator(prefetchPartitions=True):
        counts.setdefault(r[0], np.zeros(1 << BITS, np.int64))[r[1]] = r[2]
    return Model(counts)


def predict(docs: DataFrame, model: Model, keep: list[str | Column] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred, score (0 to 1) and ambiguous."""
    ship(docs.sparkSession)
    base = docs.select(*(docs.columns if keep is None else keep))
    names, k = column_names(base, "lang_pred", "score", "ambiguous"), len(base.columns)
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(k).to_pylist()]
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], names=[*batch.schema.names[:k], *names])

    (text,) = column_names(base, "text_in")
    return docs.select(*(docs.columns if keep is None else keep), docs[text_col].alias(text)).mapInArrow(run, schema)
