"""Byte-level BPE encoding and decoding (operator 7).

The ``tokenizers`` library runs over Arrow batches. The rank file gives the vocabulary; every split of a token into two
ranked halves is a merge, in rank order, which makes the library merge what rank-driven BPE merges. Bytes are written as
printable characters (the byte table) for the library and mapped back for decoding.

A text is cut by the pattern first, and each distinct match of an Arrow batch is encoded once: matches never merge with
each other, so a bounded memo of matches changes no id. No shuffle; memory per task is one batch, one memo and the model.

Cases: null and empty texts give no tokens; texts of any length are encoded whole; repeated rows give repeated results;
extra columns pass through, and a result column whose name is taken gets an underscore.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import column_names, ship

#: Matches kept in a worker's memo, and the longest match that is kept.
MEMO_SIZE, MEMO_CHARS = 100_000, 48


def byte_table() -> list[str]:
    """Character for each byte: printable Latin-1 bytes stand for themselves, the rest follow from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task; its threads would also hold memory of their own
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_table()
        spell = lambda token: "".join(chars[b] for b in token)
        merges = [(spell(t[:i]), spell(t[i:])) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        vocab = {spell(t): r for t, r in ranks.items()}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {r: bytes(back[c] for c in t) for t, r in vocab.items()}
        self.find, self.memo = regex.compile(pattern).findall, {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        fresh = list({w for words in cut for w in words}.difference(self.memo))
        known = self.memo
        if len(known) + len(fresh) > MEMO_SIZE:
            known = self.memo = {}
            fresh = list({w for words in cut for w in words})
        spare = {}
        for lo in range(0, len(fresh), 5_000):
            part = fresh[lo : lo + 5_000]
            for word, got in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)):
                (known if len(word) <= MEMO_CHARS and len(known) < MEMO_SIZE else spare)[word] = np.array(got.ids, "<u4").tobytes()
        both = {**known, **spare} if spare and len(spare) > 1000 else None
        out = []
        for words in cut:
            try:
                out.append(b"".join(map((both or known).__getitem__, words)))
            except KeyError:
                out.append(b"".join([known[w] if w in known else spare[w] for w in words]))
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, data: bytes) -> np.ndarray:
        """Code-point span of each token, as (start, end) rows. A token that holds part of a character spans all of it."""
        lens = np.array([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        ends = np.cumsum(lens)
        begun = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        starts = ends - lens
        return np.stack([begun[np.minimum(starts + 1, len(data))] - 1 if len(data) else starts, begun[ends]], axis=1).astype(np.int32)


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> Codec:
    """The worker's codec, built once for all its tasks."""
    return Codec(path, pattern)


def decode_pieces(pieces: list[bytes]) -> list[str]:
    """Text of consecutive token bytes, one string a token; a split character appears with the token that completes it."""
    import codecs

    step = codecs.getincrementaldecoder("utf-8")("replace")
    return [step.decode(p, i == len(pieces) - 1) for i, p in enumerate(pieces)]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_offsets: bool = False, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Append ``ids`` (array of int) and ``decoded`` (binary), or with ``digests`` their counts and SHA-256 digests.

    ``keep``: the columns to carry over (all by default). ``with_offsets`` adds ``offsets``: [start, end) per token in code points.
    """
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    base = docs.select(*keep)
    names = column_names(base, *(("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")), *(["offsets"] if with_offsets else []))
    kinds = ([T.LongType(), T.StringType(), T.StringType()] if digests else [T.ArrayType(T.IntegerType()), T.BinaryType()]) + [T.ArrayType(T.ArrayType(T.IntegerType()))] * with_offsets
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    (text,) = column_names(docs, "text_in")
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = [t or "" for t in batch.column(n_keep).to_pylist()]
                ids = codec.encode_all(texts)
                back = [codec.decode_bytes(x) for x in ids]
                if digests:
                    made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                else:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    made = [pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(back, pa.binary())]
                if with_offsets:
                    made.append(pa.array([codec.offsets(i, b).tolist() for i, b in zip(ids, back)], pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=[*batch.schema.names[:n_keep], *names])

    return docs.select(*keep, docs[text_col].alias(text)).mapInArrow(run, schema)
