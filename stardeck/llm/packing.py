"""Harmonic packing of documents into sequences of a fixed capacity C, a power of two.

A document of n tokens fills n // C sequences by itself; what remains is its rest of r < C tokens. Rests of
C/(k + 1) < r <= C/k tokens form class k, and a bin of class k takes exactly k of them, whole. What the k rests
leave free in their bin is filled by the head of the documents that come next, so a document is cut at most
where its head closes such a gap, and at each C tokens. Each worker fills its own bins, without a shuffle. The
bins that are still open at the end of its partition are emptied into common sequences; the last of these
is closed as sequences of a power of two. So nothing is padded, and a worker holds less than one open bin a class.

Cases: a null or empty text is the closing id alone; a null id keeps its null; repeated rows are packed
each; an empty table gives an empty result. A very long text is held once as ids (four bytes each).
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Words whose ids a worker remembers; beyond that it starts anew.
MOST_WORDS = 400_000
LONG_WORD = 200
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Word (bytes without ASCII white space) to its ids (little-endian uint32), by the given tokenizer.

    The tokenizer parts texts at white space at the latest, so words can be encoded alone. Plain letters
    with punctuation behind them go to its BPE model directly; all else, so also the names of its special
    tokens, goes through the whole tokenizer. Long words are not remembered.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.visible = byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        letters = text.rstrip(string.punctuation)
        plain = letters.lower()
        if letters.isalpha() and plain.isalpha() and "Σ" not in letters and unicodedata.is_normalized("NFC", letters):
            ids = self._piece(plain) + (self._piece(text[len(letters) :]) if len(text) > len(letters) else b"")
        else:
            ids = _packed(self.whole.encode(text, add_special_tokens=False).ids)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.visible)
        return _packed([t.id for t in self.model.tokenize(piece)])


def byte_letters() -> dict[int, str]:
    """Each byte's visible letter in byte-level vocabularies: itself where it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Bin:
    """A sequence that is being filled: pieces (document, start, ids, tokens of the document)."""

    def __init__(self, room: int):
        self.room, self.rests = room, 0
        self.pieces: list[tuple] = []

    def put(self, doc: int | None, start: int, ids: memoryview, n: int) -> None:
        self.pieces.append((doc, start, memoryview(bytes(ids)), n))  # a copy: a piece must not hold its whole document
        self.room -= len(ids) // 4


class Bins:
    """One worker's open bins: one for each class, and those that have their rests but a gap."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, Bin] = {}
        self.gaps: list[Bin] = []
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: memoryview) -> None:
        n, at = len(ids) // 4, 0
        while self.gaps and at < n:
            gap = self.gaps[-1]
            length = min(gap.room, n - at)
            gap.put(doc, at, ids[4 * at : 4 * (at + length)], n)
            at += length
            if not gap.room:
                self._close(self.gaps.pop())
        while n - at >= self.capacity:
            whole = Bin(self.capacity)
            whole.put(doc, at, ids[4 * at : 4 * (at + self.capacity)], n)
            self._close(whole)
            at += self.capacity
        if at < n:
            self._rest(doc, at, ids[4 * at :], n)

    def _rest(self, doc: int | None, at: int, ids: memoryview, n: int) -> None:
        k = self.capacity // (len(ids) // 4)
        held = self.open.setdefault(k, Bin(self.capacity))
        held.put(doc, at, ids, n)
        held.rests += 1
        if held.rests == k:
            del self.open[k]
            if held.room:
                self.gaps.append(held)
            else:
                self._close(held)

    def _close(self, full: Bin) -> None:
        offset = 0
        for doc, start, ids, n in full.pieces:
            length = len(ids) // 4
            self.rows.append((doc, start, length, zlib.crc32(ids), n, self.next, offset))
            offset += length
        self.next += 1

    def finish(self) -> None:
        """Empties the open bins into sequences of C, and of powers of two below it in the end."""
        left = [p for held in [*self.gaps, *self.open.values()] for p in held.pieces]
        self.gaps, self.open = [], {}
        total = sum(len(p[2]) // 4 for p in left)
        into = None
        for doc, start, ids, n in left:
            while len(ids):
                if into is None:
                    room = min(self.capacity, 1 << (total.bit_length() - 1))
                    into, total = Bin(room), total - room
                length = min(into.room, len(ids) // 4)
                into.put(doc, start, ids[: 4 * length], n)
                start, ids = start + length, ids[4 * length :]
                if not into.room:
                    self._close(into)
                    into = None

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])


def _pack(path: str, capacity: int, end_id: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path).__getitem__
        end = end_id.to_bytes(4, "little")
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in pieces(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                bins.add(doc, memoryview(b"".join([*map(ids_of, words), end])))
            yield bins.batch()
        bins.finish()
        yield bins.batch()

    return make


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence's id holds the number of its partition in the upper bits. The file at tokenizer_path must be
    at that place on every worker.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    d = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return d.mapInArrow(_pack(tokenizer_path, capacity, end_id), PIECES)
