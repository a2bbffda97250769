"""Sum-of-squares packing (operator 11).

Each document becomes its token ids and an end id. Whole windows of a longer document are sequences of their own; what is left,
shorter than a window, goes online to the fill level that makes the sum of N(h)^2 smallest, N(h) being the number of open windows
filled to level h (h = 0 opens a window; ties go to the fullest). The counts N are one array with an entry a level, so a placement
is one vectorised pass over it. When a task's rows end, its open windows are filled up: the emptiest give their pieces to the
fullest, cut where need be, and the last one's tokens become sequences of powers of two, which the law of the output leaves
unpadded. So no sequence is padded, and at most one short sequence a bit of the window length is made a task.

There is no shuffle: every partition of the input packs on its own, and sequence ids carry the partition. A task holds one slice
of texts, two memos of bounded size and the open windows (their ids, and the kept columns of their documents). A sequence lies within
one task, so a task that is run again makes the same sequences from the same rows; write a frame whose partitions depend on
the order of a shuffle with ``stage`` first.

Tokens: a space before a letter or digit always starts a match of the tokenizer's pattern, and so does punctuation after a letter
or digit, a line's end and a word that begins a line. Texts are cut there, and the ``tokenizers`` library encodes each distinct word once a memo.

Cases: null and empty texts are the end id alone; texts of any length are taken whole; strings of special tokens in a text are
ordinary text; repeated rows are packed each on its own; an empty table gives no piece; extra columns pass through ``keep``, and
a result whose name is taken gets an underscore.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.byte_bpe import byte_table
from waymark.llm.common import column_names, ship

#: Words and stretches of text that a worker keeps the ids of, the longest one of these, and texts that are encoded at a time.
MEMO_WORDS, MEMO_UNITS, MEMO_CHARS, SLICE = 1_200_000, 400_000, 40, 512
_CUT = re.compile(r" (?=[0-9A-Za-zÀ-ɏ])")
#: Letters that every version of the pattern's classes has; the library's printable character for each byte.
_LETTERS, _BYTES = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch, dict(enumerate(byte_table()))
#: A word's end and marks, and perhaps a line's end, a word and marks: match starts all of them, after a word that a space precedes.
_PARTS = re.compile(r"([^\W_](?:[^\s]*[^\W_])?)([.,;:!?]*)(?:\n([^\W_](?:[^\s]*[^\W_])?)([.,;:!?]*))?").fullmatch


class Encoder:
    """The library's encoder behind memos of words and of stretches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.model, self.units, self.words = Tokenizer.from_file(path), {}, {}
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.firsts, self.marks, self.line = {"": b""}, {"": b""}, self._plain(["\n"])[0]

    def _plain(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 5_000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts[lo : lo + 5_000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of ``words`` with ``before`` (a space or nothing) in front. A word of Latin letters is one match, so the library's model alone has to split it."""
        out, one, bpe = dict.fromkeys(words), _LETTERS, self.model.model.tokenize
        spelled = {w: (before + w).encode().decode("latin-1").translate(_BYTES) for w in words if one(w)}
        out.update((w, array("I", [t.id for t in bpe(s)]).tobytes()) for w, s in spelled.items())
        rest = [w for w in words if w not in spelled]
        out.update(zip(rest, self._plain([before + w for w in rest])))
        return list(out.values())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_CUT.split(t) for t in texts]
        heads = self._plain([c.pop(0) for c in cut])
        if len(self.words) > MEMO_WORDS:
            self.words, self.firsts, self.marks = {}, {"": b""}, {"": b""}
        if len(self.units) > MEMO_UNITS:
            self.units = {}
        units, words, firsts, marks, line = self.units, self.words, self.firsts, self.marks, self.line
        fresh = set(chain.from_iterable(cut)).difference(units)
        parts = {w: found.groups("") for w in fresh if not w.isalpha() and (found := _PARTS(w)) and found[1] != w}
        whole = fresh.difference(parts)
        new = list({p[0] for p in parts.values()}.union(whole).difference(words))
        bare, ends = list({p[2] for p in parts.values()}.difference(firsts)), list({m for p in parts.values() for m in p[1::2]}.difference(marks))
        words.update(zip(new, self._words(new, " ")))
        firsts.update(zip(bare, self._words(bare, "")))
        marks.update(zip(ends, self._plain(ends)))
        units.update(zip(whole, map(words.__getitem__, whole)))
        units.update((w, words[stem] + marks[mark] + (line + firsts[first] + marks[last] if first else b"")) for w, (stem, mark, first, last) in parts.items())
        get = units.__getitem__
        out = [h + b"".join(map(get, c)) for h, c in zip(heads, cut)]
        for table, made in ((units, fresh), (words, new), (firsts, bare), (marks, ends)):
            for w in made:
                if len(w) > MEMO_CHARS:
                    del table[w]
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, read once for all its tasks."""
    return Encoder(path)


class Windows:
    """Open windows by fill level. A window is a list of pieces (row, start, ids, doc_tokens); ids are bytes, four a token."""

    def __init__(self, window: int):
        self.window, self.count = window, np.zeros(window + 1, np.int64)
        self.open: list[deque] = [deque() for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The fill level to place ``size`` tokens at (0 < size < window): the smallest sum of squared counts, then the fullest."""
        n, most = self.count, self.window - size
        cost = 2 * n[size:] + 1  # what a window more at level h + size adds
        cost[most] = 0  # a full window is closed
        cost[1:] -= 2 * n[1 : most + 1] - 1  # what a window less at level h takes away
        cost[1:][n[1 : most + 1] == 0] = np.iinfo(np.int64).max
        return most - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put a piece of fewer tokens than a window where it belongs; the window, if this fills it."""
        size = len(piece[2]) // 4
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].popleft()
            self.count[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        return None

    def finish(self) -> Iterator[list]:
        """Close all windows: the emptiest fill the fullest, the last becomes sequences of powers of two."""
        left = deque([level, pieces] for level in range(self.window, 0, -1) for pieces in self.open[level])
        while len(left) > 1:
            full, donor = left[0], left[-1]
            row, start, data, tokens = donor[1].pop()
            room = self.window - full[0]
            given, rest = data[: 4 * room], data[4 * room :]
            full[1].append((row, start, given, tokens))
            full[0] += len(given) // 4
            donor[0] -= len(given) // 4
            if rest:
                donor[1].append((row, start + room, rest, tokens))
            if not donor[1]:
                left.pop()
            if full[0] == self.window:
                yield left.popleft()[1]
        for size, pieces in left:
            while size:
                take, size, part = 1 << (size.bit_length() - 1), size - (1 << (size.bit_length() - 1)), []
                while take:
                    row, start, data, tokens = pieces.pop(0)
                    part.append((row, start, data[: 4 * take], tokens))
                    if len(data) > 4 * take:
                        pieces.insert(0, (row, start + take, data[4 * take :], tokens))
                    take -= len(part[-1][2]) // 4
                yield part
        self.open, self.count = [deque() for _ in self.open], np.zeros_like(self.count)

    def pieces(self) -> Iterator[list]:
        return (pieces for level in self.open for pieces in level)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """A row for each piece: ``keep`` columns, start, length, ids (array of int; with ``digests`` ids_crc32), doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    base = docs.select(*keep)
    names = column_names(base, "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset")
    kinds = [T.LongType(), T.LongType(), T.LongType() if digests else T.ArrayType(T.IntegerType()), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    (text,) = column_names(base, "text_in")
    n_keep, end = len(keep), int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = encoder_of(path), Windows(window)
        sequence, held, kept = TaskContext.get().partitionId() << 33, None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                own = pa.Table.from_batches([batch.select(range(n_keep))]) if n_keep else None
                first = held.num_rows if held is not None else 0
                kept = own if held is None else pa.concat_tables([held, own])
                closed = []
                for row, data in enumerate(encoder.encode([t or "" for t in batch.column(n_keep).to_pylist()]), first):
                    data += end
                    tokens = len(data) // 4
                    cut = tokens - tokens % window
                    closed += [[(row, at, data[4 * at : 4 * (at + window)], tokens)] for at in range(0, cut, window)]
                    if cut < tokens:
                        full = windows.place((row, cut, data[4 * cut :], tokens))
                        closed += [full] if full else []
                if closed:
                    yield _rows(closed, kept, sequence, schema, digests)
                    sequence += len(closed)
                used = sorted({p[0] for pieces in windows.pieces() for p in pieces})
                place = {row: i for i, row in enumerate(used)}
                for pieces in windows.pieces():
                    pieces[:] = [(place[r], *rest) for r, *rest in pieces]
                held = kept.take(pa.array(used, pa.int64())).combine_chunks() if own is not None else None
        closed = list(windows.finish())
        if closed:
            yield _rows(closed, held, sequence, schema, digests)

    return docs.select(*keep, docs[text_col].alias(text)).mapInArrow(run, schema)


def _rows(closed: list[list], kept: pa.Table | None, sequence: int, schema: T.StructType, digests: bool) -> pa.RecordBatch:
    """The pieces of closed windows as result rows; their ids count from ``sequence`` on."""
    pieces = [(*p, sequence + i) for i, one in enumerate(closed) for p in one]
    lengths = np.array([len(p[2]) // 4 for p in pieces], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.concatenate([[0], np.cumsum([len(one) for one in closed])[:-1]]).astype(np.int64)
    offsets = begins - np.repeat(begins[first], [len(one) for one in closed])
    if digests:
        ids = pa.array([zlib.crc32(p[2]) for p in pieces], pa.int64())
    else:
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(p[2] for p in pieces), "<u4").astype(np.int32)))
    own = [] if kept is None else [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.take(pa.array([p[0] for p in pieces], pa.int64())).columns]
    made = [pa.array([p[1] for p in pieces], pa.int64()), pa.array(lengths), ids, pa.array([p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()), pa.array(offsets)]
    return pa.RecordBatch.from_arrays([*own, *made], names=[f.name for f in schema.fields])
