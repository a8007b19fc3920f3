"""Interpolated modified Kneser-Ney bigram scores from sorted arrays that workers map into memory.

Counting is three shuffles. (1) Words: tasks count the hashes of bounded stretches of tokens and send them to
shards by hash range; each shard writes a sorted array of hashes and their counts. A word's place in the
concatenated arrays is its id. (2) Pairs: tasks map those arrays, count pairs of ids and send them, sorted,
packed and compressed, to the shard of the first word; each shard writes a sorted array of pair keys with
counts. Words that are more than 1/(2 x shards) of all tokens have their pairs dealt by key instead, to as many
shards again, so that no first word makes a large shard. (3) Continuations: how many different words come
before each word, and how many pairs of count 1, 2 and more each word begins, go to the words' shards. The driver
gets a row of sums for each shard. Scoring maps the arrays and looks a batch's different words and pairs up, sorted.

Of order 3 there are two more. (4) Triples: tasks look up the place of each pair in its shard, and count (place, word), which
go to that shard and become a sorted array there; what follows a pair is summed next to it. (5) How many different
words come before each pair goes to the pair's shard, and takes the place of its count.

A shard's arrays lie in a few files, written under another name and renamed, so a task that runs again leaves the same files,
and every shard has all of them, be they empty. The folder must be one that all workers see as a file system, as memory maps need; it is made in spark.checkpoint.dir.

Texts are words with A-Z lower-cased and one end; starts, one less than the order, which are only ever contexts, stand
before them. P(w | v) = max(c(vw) - D(c), 0) / c(v) + g(v) P1(w), P1 from continuation counts, discounted likewise and
interpolated with 1 / (V + 1), one share of which is for all unknown words; and so on from pairs to triples.

Cases: a null or empty text is its end alone; a row with a null id is held out; repeated rows count each time;
with nothing to learn from, every token has probability 1 / (V + 1) = 1; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, hashes, mix, shared_dir, words_of

#: Tokens that a task counts at once.
STRETCH = 2_000_000
#: No word can be equal to these: they hold white space.
START, END = hashes([b"\n start"])[0], hashes([b"\n end"])[0]
BIG = 255
COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    """An array of unsigned integers, its bytes ordered by significance and compressed."""
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
    return keys[first], np.add.reduceat(counts, first)


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of several arrays: the length of a header, the header (their names, kinds and lengths), then each from a multiple of 64 bytes on."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{os.getpid()}-{uuid.uuid4().hex}"
    header = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    with open(own, "wb") as f:
        f.write(len(header).to_bytes(8, "little") + header)
        for a in arrays.values():
            f.write(b"\0" * (-f.tell() % 64) + np.ascontiguousarray(a).tobytes())
    os.replace(own, f"{folder}/{name}")


@lru_cache(20_000)
def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file. Every shard has all its files, so one that is missing or cut short is an error."""
    path = f"{folder}/{name}"
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} of the model is missing, or {folder} is not the same folder on all machines")
    raw = np.memmap(path, np.uint8, "r")
    at = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for key, kind, n in json.loads(raw[8:at].tobytes()):
        at += -at % 64
        size = n * np.dtype(kind).itemsize
        if at + size > len(raw):
            raise ValueError(f"{path} of the model is cut short")
        out[key] = raw[at : at + size].view(kind) if size else np.empty(0, kind)
        at += size
    return out


#: The kind of file that holds an array of words, and of pairs.
PAIR_FILE = {"times": "pairs", "lead": "leads", "after": "triples", "once": "triples", "twice": "triples", "thrice": "triples"}
FILE = {"word": "words", "count": "words", "before": "statistics", "total": "contexts", "one": "contexts", "two": "contexts", "more": "contexts"}


def _on_all_machines(spark: SparkSession, folder: str) -> None:
    """Raises where a task does not see what the driver writes: before hours of counting, not after."""
    _save(folder, "seen", {})
    n = 4 * spark.sparkContext.defaultParallelism

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _mapped(folder, "seen")
            yield batch

    spark.range(0, n, 1, n).mapInArrow(look, "id long").count()


def _every_shard(rows: DataFrame, shards: int) -> DataFrame:
    """rows and, for each shard, one that holds nothing: so each shard's task runs, and writes its files, whatever falls to it."""
    nothing = [F.lit(bytearray(pack(np.empty(0, np.uint64)))).alias(c) for c in rows.columns if c != "shard"]
    return rows.unionByName(rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), *nothing))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _by_shard(shard_of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array of shards."""
    if len(shard_of):
        cut = np.concatenate([[0], np.nonzero(shard_of[1:] != shard_of[:-1])[0] + 1, [len(shard_of)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(shard_of[a]), slice(a, b)


def tokens(texts: list[str | None], starts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of starts, words and end of each text, in a row, and where the texts begin."""
    parts, at, n = [], [], 0
    for t in texts:
        w = words_of(t)
        at.append(n)
        parts += [np.full(starts, START), hashes(w), np.array([END])]
        n += len(w) + starts + 1
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(at, np.int64)


def _stretches(batches: Iterator[pa.RecordBatch], starts: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in pieces(batches, 0):
        held.append(tokens(batch.column(0).to_pylist(), starts)[0])
        n += len(held[-1])
        if n >= STRETCH:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _count_words(shards: int, starts: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches, starts):
            keys, counts = np.unique(stretch, return_counts=True)
            rows = [(s, pack(keys[k]), pack(counts[k].astype(np.uint64))) for s, k in _by_shard(_shard(keys, shards))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["shard", "keys", "counts"]).astype({"shard": "int32"}))

    return make


def _write_words(folder: str, hot_share: float):
    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(x, np.uint64) for x in rows["keys"]])
        counts = np.concatenate([unpack(x, np.uint64) for x in rows["counts"]])
        keys, counts = summed(keys, counts)
        _save(folder, f"words-{key[0]}", {"word": keys, "count": counts})
        real = counts[keys != START].sum()
        # of a shard's own words only those can be hot that have this share of it, too; the driver looks at these again
        hot = np.nonzero(counts > hot_share * real)[0] if len(counts) else np.empty(0, np.int64)
        return pd.DataFrame({"shard": [key[0]], "n": [len(keys)], "tokens": [int(real)], "texts": [int(counts[keys == START].sum())], "hot": [hot.tolist()], "hot_counts": [counts[hot].tolist()], "start": [int(np.append(np.nonzero(keys == START)[0], -1)[0])]})

    return make


class Words:
    """The words' arrays of all shards, mapped: ids, counts and statistics of hashes."""

    def __init__(self, folder: str, offsets: list[int]):
        self.folder, self.offsets, self.shards = folder, offsets, len(offsets) - 1

    def look_up(self, h: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
        """Ids (-1: unknown) of sorted hashes, and their entries (0: unknown) in the arrays of these names."""
        ids = np.full(len(h), -1, np.int64)
        out = [np.zeros(len(h), np.int64) for _ in names]
        for s, k in _by_shard(_shard(h, self.shards)):
            held = _mapped(self.folder, f"words-{s}")["word"]
            if not len(held):
                continue
            at = np.minimum(np.searchsorted(held, h[k]), len(held) - 1)
            known = held[at] == h[k]
            ids[k] = np.where(known, at + self.offsets[s], -1)
            for o, name in zip(out, names, strict=True):
                o[k] = np.where(known, _mapped(self.folder, f"{FILE[name]}-{s}")[name][at], 0)
        return (ids, *out)


def _pair_shards(keys: np.ndarray, words: Words, hot: np.ndarray) -> np.ndarray:
    first = (keys >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(words.offsets, first, side="right") - 1
    if len(hot):
        place = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        at = np.where(hot[place] == first, words.shards + (mix(keys) % np.uint64(words.shards)).astype(np.int64), at)
    return at


def _count_pairs(folder: str, offsets: list[int], hot: list[int], starts: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, often = Words(folder, offsets), np.array(hot, np.int64)
        for stretch in _stretches(batches, starts):
            different, place = np.unique(stretch, return_inverse=True)
            ids = words.look_up(different)[0][place].astype(np.uint64)
            # two starts are a context, too
            keys = ((ids[:-1] << np.uint64(32)) | ids[1:])[(stretch[1:] != START) | (stretch[:-1] == START)]
            keys, counts = np.unique(keys, return_counts=True)
            yield _sent(keys, counts, _pair_shards(keys, words, often))

    return make


SENT = "shard int, gaps binary, n binary, second binary, counts binary"
LOW = np.uint64(2**32 - 1)


def _sent(keys: np.ndarray, counts: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """SENT rows: sorted keys of two halves with counts, packed for each shard."""
    order = np.argsort(at, kind="stable")
    keys, counts, at = keys[order], counts[order].astype(np.uint32), at[order]
    rows = []
    for s, k in _by_shard(at):
        first, n = np.unique(keys[k] >> np.uint64(32), return_counts=True)
        gaps = np.diff(first, prepend=np.uint64(0)).astype(np.uint32)
        rows.append((s, pack(gaps), pack(n.astype(np.uint32)), pack((keys[k] & LOW).astype(np.uint32)), pack(counts[k])))
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["shard", "gaps", "n", "second", "counts"]).astype({"shard": "int32"}))


def _received(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of SENT rows of a shard, sorted, and the sums of their counts."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for r in rows.itertuples():
        first = np.repeat(np.cumsum(unpack(r.gaps, np.uint32), dtype=np.uint64), unpack(r.n, np.uint32))
        keys.append((first << np.uint64(32)) | unpack(r.second, np.uint32))
        counts.append(unpack(r.counts, np.uint32))
    return summed(np.concatenate(keys), np.concatenate(counts))


def _small(name: str, a: np.ndarray) -> dict[str, np.ndarray]:
    """An array of which most values are small: bytes, and the places and values of those that don't fit."""
    big = np.nonzero(a >= BIG)[0]
    return {name: np.where(a >= BIG, BIG, a).astype(np.uint8), f"{name}-at": big.astype(np.uint64), f"{name}-is": a[big].astype(np.uint64)}


def _values(held: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Values of such an array."""
    out = held[name][at].astype(np.int64)
    big = np.nonzero(out == BIG)[0]
    if len(big):
        out[big] = held[f"{name}-is"][np.searchsorted(held[f"{name}-at"], at[big].astype(np.uint64))]
    return out


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _followed(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each of the sorted contexts: the sum of the counts, and how many are 1, 2 and more."""
    context, begin = np.unique(first, return_index=True)
    parts = (counts, counts == 1, counts == 2, counts >= 3)
    return context, [np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.empty(0, np.int64) for x in parts]


def _located(folder: str, keys: np.ndarray, words: Words, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards of sorted pairs and their places there (-1: unknown)."""
    at, place = _pair_shards(keys, words, hot), np.full(len(keys), -1, np.int64)
    order = np.argsort(at, kind="stable")
    for s, k in _by_shard(at[order]):
        mine, held = order[k], _mapped(folder, f"pairs-{s}")["pair"]
        if len(held):
            found = np.minimum(np.searchsorted(held, keys[mine]), len(held) - 1)
            place[mine] = np.where(held[found] == keys[mine], found, -1)
    return at, place


def _count_triples(folder: str, offsets: list[int], hot: list[int]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, often = Words(folder, offsets), np.array(hot, np.int64)
        for stretch in _stretches(batches, 2):
            different, place = np.unique(stretch, return_inverse=True)
            ids = words.look_up(different)[0][place].astype(np.uint64)
            real = np.nonzero(stretch[2:] != START)[0]
            context, back = np.unique(((ids[:-1] << np.uint64(32)) | ids[1:])[real], return_inverse=True)
            shard, where = _located(folder, context, words, often)
            keys, at = (where[back].astype(np.uint64) << np.uint64(32)) | ids[2:][real], shard[back]
            order = np.lexsort((keys, at))
            keys, at = keys[order], at[order]
            first = np.nonzero(np.append(True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])))[0] if len(keys) else np.empty(0, np.int64)
            yield _sent(keys[first], np.diff(np.append(first, len(keys))), at[first])

    return make


def _write_triples(folder: str, offsets: list[int], hot: list[int]):
    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s, (keys, counts) = key[0], _received(rows)
        pairs = _mapped(folder, f"pairs-{s}")["pair"]
        arrays = {"triple": keys} | _small("often", counts)
        first = (keys >> np.uint64(32)).astype(np.int64)
        context, sums = _followed(first, counts)
        for name, x in zip(("after", "once", "twice", "thrice"), sums, strict=True):
            whole = np.zeros(len(pairs), np.int64)
            whole[context] = x
            arrays |= _small(name, whole)
        _save(folder, f"triples-{s}", arrays)
        out = [(-1, pack(np.array(_counts_of_counts(counts), np.uint64)), b"")]
        ends, before = np.unique(((pairs[first] & LOW) << np.uint64(32)) | (keys & LOW), return_counts=True)
        at = _pair_shards(ends, Words(folder, offsets), np.array(hot, np.int64))
        order = np.argsort(at, kind="stable")
        for to, k in _by_shard(at[order]):
            out.append((to, pack(ends[order[k]]), pack(before[order[k]].astype(np.uint32))))
        return pd.DataFrame(out, columns=["shard", "keys", "before"]).astype({"shard": "int32"})

    return make


def _write_continuations(folder: str, offsets: list[int]):
    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = key[0]
        if s < 0:
            return pd.DataFrame([(-1, pack(np.sum([unpack(x, np.uint64) for x in rows["keys"]], axis=0)), b"", b"", b"", b"")], columns=["shard", "ids", "t", "a", "b", "c"]).astype({"shard": "int32"})
        pairs = _mapped(folder, f"pairs-{s}")["pair"]
        before = np.zeros(len(pairs), np.int64)
        for r in rows.itertuples():
            before[np.searchsorted(pairs, unpack(r.keys, np.uint64))] += unpack(r.before, np.uint32)
        _save(folder, f"leads-{s}", _small("lead", before))
        out = [(-2, pack(np.array(_counts_of_counts(before), np.uint64)), b"", b"", b"", b"")]
        context, sums = _followed(pairs >> np.uint64(32), before)
        for to, k in _by_shard(np.searchsorted(offsets, context, side="right") - 1):
            out.append((to, pack((context[k] - np.uint64(offsets[to])).astype(np.uint32)), *[pack(x[k].astype(np.uint32)) for x in sums]))
        return pd.DataFrame(out, columns=["shard", "ids", "t", "a", "b", "c"]).astype({"shard": "int32"})

    return make


def _write_contexts(folder: str, sizes: list[int]):
    """What follows each word in how many different places: a word's pairs may lie in several shards."""

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = key[0]
        if s < 0:
            return pd.DataFrame({"shard": [s], "sums": [np.sum([unpack(x, np.uint64) for x in rows["ids"]], axis=0).astype(np.int64).tolist()]})
        held = [np.zeros(sizes[s], np.uint32) for _ in range(4)]
        for r in rows.itertuples():
            ids = unpack(r.ids, np.uint32)
            for total, x in zip(held, (r.t, r.a, r.b, r.c), strict=True):
                total[ids] += unpack(x, np.uint32)
        _save(folder, f"contexts-{s}", dict(zip(("total", "one", "two", "more"), held, strict=True)))
        return pd.DataFrame({"shard": [s], "sums": [[0] * 4]})

    return make


def _write_pairs(folder: str, offsets: list[int], order: int, start: int):
    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _received(rows)
        _save(folder, f"pairs-{key[0]}", {"pair": keys} | (_small("times", counts) if order == 2 else {}))
        predicted = (keys & LOW) != np.uint64(start)
        out = [(-1, pack(np.array([*_counts_of_counts(counts), int(predicted.sum())], np.uint64)), b"", b"", b"")]
        second, before = np.unique((keys & LOW)[predicted], return_counts=True)
        for s, k in _by_shard(np.searchsorted(offsets, second, side="right") - 1):
            out.append((s, pack((second[k] - np.uint64(offsets[s])).astype(np.uint32)), pack(before[k].astype(np.uint32)), b"", b""))
        if order == 2:
            first, (_, *by) = _followed(keys >> np.uint64(32), counts)
            for s, k in _by_shard(np.searchsorted(offsets, first, side="right") - 1):
                out.append((s, pack((first[k] - np.uint64(offsets[s])).astype(np.uint32)), *[pack(x[k].astype(np.uint32)) for x in by]))
        return pd.DataFrame(out, columns=["shard", "ids", "a", "b", "c"]).astype({"shard": "int32"})

    return make


def _write_statistics(folder: str, sizes: list[int], order: int):
    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = key[0]
        if s < 0:
            return pd.DataFrame({"shard": [s], "sums": [np.sum([unpack(x, np.uint64) for x in rows["ids"]], axis=0).astype(np.int64).tolist()]})
        before, one, two, more = (np.zeros(sizes[s], np.uint32) for _ in range(4))
        for r in rows.itertuples():
            ids = unpack(r.ids, np.uint32)
            if not r.b:
                before[ids] += unpack(r.a, np.uint32)
            else:
                for total, x in ((one, r.a), (two, r.b), (more, r.c)):
                    total[ids] += unpack(x, np.uint32)
        _save(folder, f"statistics-{s}", {"before": before})
        if order == 2:
            _save(folder, f"contexts-{s}", {"one": one, "two": two, "more": more})
        return pd.DataFrame({"shard": [s], "sums": [[int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 0).sum())]]})

    return make


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2 and more (Chen and Goodman); 1/2 each where the counts of counts are too few to say."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *[min(max(x, 0.01), k + 0.99) for k, x in enumerate(raw)]])


class Model:
    """Where the arrays are, and the sums that probabilities need. Small; goes to tasks with their code."""

    def __init__(self, folder: str, offsets: list[int], hot: list[int], tokens: int, texts: int, levels: list[list[int]], n_pairs: int, order: int):
        """levels: of single words, pairs and so on up to the order, how many occur once, twice, ...; of words a fifth number, of all."""
        self.folder, self.offsets, self.hot, self.order = folder, offsets, hot, order
        self.tokens, self.texts = tokens, texts
        self.vocabulary = max(0, offsets[-1] - (texts > 0))
        self.d1, self.d2, *self.d3 = [discounts(*x[:4]) for x in levels]
        self.n_pairs = n_pairs
        if self.n_pairs:
            n1, n2 = levels[0][:2]
            self.rest = (self.d1[1] * n1 + self.d1[2] * n2 + self.d1[3] * (levels[0][4] - n1 - n2)) / self.n_pairs
        else:
            self.rest = 1.0

    def unigram(self, before: np.ndarray) -> np.ndarray:
        p = np.maximum(before - self.d1[np.minimum(before, 3)], 0) / max(self.n_pairs, 1)
        return p + self.rest / (self.vocabulary + 1)

    def pairs(self, ids: np.ndarray, words: Words, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
        """Of each two neighbours in ids: the shard, the place there (-1: unknown) and the entries (0: unknown) of the arrays of these names."""
        out = [np.zeros(len(ids) - 1, np.int64) for _ in range(2 + len(names))]
        out[1][:] = -1
        both = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
        keys, back = np.unique((ids[both].astype(np.uint64) << np.uint64(32)) | ids[both + 1].astype(np.uint64), return_inverse=True)
        shard, place = _located(self.folder, keys, words, np.array(self.hot, np.int64))
        entries = [np.zeros(len(keys), np.int64) for _ in names]
        known = np.nonzero(place >= 0)[0]
        known = known[np.argsort(shard[known], kind="stable")]
        for s, k in _by_shard(shard[known]):
            mine = known[k]
            for e, name in zip(entries, names, strict=True):
                e[mine] = _values(_mapped(self.folder, f"{PAIR_FILE[name]}-{s}"), name, place[mine])
        for o, x in zip(out, (shard, place, *entries), strict=True):
            o[both] = x[back]
        return tuple(out)

    def triples(self, shard: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How often each word follows the pair at this place of this shard."""
        out = np.zeros(len(w), np.int64)
        known = np.nonzero((place >= 0) & (w >= 0))[0]
        keys = (place[known].astype(np.uint64) << np.uint64(32)) | w[known].astype(np.uint64)
        order = np.lexsort((keys, shard[known]))
        for s, k in _by_shard(shard[known][order]):
            mine, file = order[k], _mapped(self.folder, f"triples-{s}")
            if len(held := file["triple"]):
                at = np.minimum(np.searchsorted(held, keys[mine]), len(held) - 1)
                hit = held[at] == keys[mine]
                out[known[mine[hit]]] = _values(file, "often", at[hit])
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, the base score and the model's, in log10."""
        starts = self.order - 1
        stream, at = tokens(texts, starts)
        if not len(at):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2
        words = Words(self.folder, self.offsets)
        different, place = np.unique(stream, return_inverse=True)
        names = ("count", "before", "one", "two", "more") + (("total",) if self.order == 3 else ())
        ids, count, before, one, two, more, *total = (x[place] for x in words.look_up(different, *names))
        real = np.nonzero(stream != START)[0]
        v = real - 1
        if self.order == 2:
            # a context is followed by something each time it occurs
            of = self.pairs(ids, words, ("times",))
            all_v = np.where(ids[v] >= 0, count[v], 0)
        else:
            of = self.pairs(ids, words, ("lead", "after", "once", "twice", "thrice"))
            all_v = total[0][v]
        p = self.unigram(before[real])
        p = _interpolated(p, self.d2, of[2][v], all_v, one[v], two[v], more[v])
        if self.order == 3:
            u = real - 2
            c = self.triples(of[0][u], of[1][u], ids[real])
            p = _interpolated(p, self.d3[0], c, *(x[u] for x in of[3:]))
        base = np.log10((count[real] + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        begin = at - starts * np.arange(len(at))
        n = np.diff(np.append(begin, len(real)))
        known = np.add.reduceat((count[real] > 0).astype(np.int64), begin)
        return n, known, np.add.reduceat(base, begin), np.add.reduceat(np.log10(p), begin)


def _interpolated(lower: np.ndarray, d: np.ndarray, c: np.ndarray, total: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The discounted share of c in its context, and the rest by the lower order; an unknown context leaves all to it."""
    seen, all_of = total > 0, np.maximum(total, 1)
    own = np.where(seen, np.maximum(c - d[np.minimum(c, 3)], 0) / all_of, 0.0)
    return own + np.where(seen, (d[1] * one + d[2] * two + d[3] * more) / all_of, 1.0) * lower


#: Shards up to which each has shard_bytes of text; beyond, shards grow with the fourth root of the text: 18 times as large at 100 TB.
EVEN_SHARDS = 64


def shards_for(size: int, shard_bytes: int) -> int:
    """How many shards for so many bytes of text."""
    grown = shard_bytes * max(1.0, size / (EVEN_SHARDS * shard_bytes)) ** 0.25
    return max(4, -(-size // int(grown)))


def train(texts: DataFrame, shard_bytes: int = 16_000_000, order: int = 2) -> Model:
    """Counts the one column of `texts`. shard_bytes: text to a shard of a small table; order: 2 or 3, the length of the longest n-grams.

    Each shard has four files (of order 3: six) of sorted arrays and gives the driver one row of sums. All of them are there
    once this returns; a file that a worker doesn't find later is an error, never an empty shard.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = texts.sparkSession
    uri = urlparse(shared_dir(spark, "kn-model"))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"memory maps need a shared folder that is mounted as a file system, not {uri.scheme}://")
    folder = uri.path
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    shards = shards_for(size, shard_bytes)
    _on_all_machines(spark, folder)
    hot_share = 1 / (2 * shards)
    counted = _every_shard(texts.mapInArrow(_count_words(shards, order - 1), "shard int, keys binary, counts binary"), shards).groupBy("shard")
    told = "shard int, n long, tokens long, texts long, hot array<long>, hot_counts array<long>, start long"
    got = {r["shard"]: r for r in counted.applyInPandas(_write_words(folder, hot_share), told).collect()}
    sizes = [got[s]["n"] if s in got else 0 for s in range(shards)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    if offsets[-1] >= 2**32:
        raise ValueError("more than 2^32 different words")
    n_tokens = sum(r["tokens"] for r in got.values())
    n_texts = sum(r["texts"] for r in got.values()) // (order - 1)
    hot = sorted(offsets[s] + i for s, r in got.items() for i, c in zip(r["hot"], r["hot_counts"], strict=True) if c > hot_share * n_tokens)
    start = max([offsets[s] + r["start"] for s, r in got.items() if r["start"] >= 0], default=2**32)
    both = 2 * shards if hot else shards  # pairs of hot words have shards of their own
    sent = _every_shard(texts.mapInArrow(_count_pairs(folder, offsets, hot, order - 1), SENT), both).groupBy("shard").applyInPandas(_write_pairs(folder, offsets, order, start), "shard int, ids binary, a binary, b binary, c binary")
    sums = {r["shard"]: r["sums"] for r in _every_shard(sent, shards).groupBy("shard").applyInPandas(_write_statistics(folder, sizes, order), "shard int, sums array<long>").collect()}
    *pairs, n_pairs = sums.pop(-1, [0] * 5)
    words = [sum(x[k] for x in sums.values()) for k in range(5)]
    levels = [words, pairs]
    if order == 3:
        sent = _every_shard(texts.mapInArrow(_count_triples(folder, offsets, hot), SENT), both).groupBy("shard").applyInPandas(_write_triples(folder, offsets, hot), "shard int, keys binary, before binary")
        sent = _every_shard(sent, both).groupBy("shard").applyInPandas(_write_continuations(folder, offsets), "shard int, ids binary, t binary, a binary, b binary, c binary")
        sums = {r["shard"]: r["sums"] for r in _every_shard(sent, shards).groupBy("shard").applyInPandas(_write_contexts(folder, sizes), "shard int, sums array<long>").collect()}
        levels = [words, sums.get(-2, [0] * 4), sums.get(-1, [0] * 4)]
    return Model(folder, offsets, hot, n_tokens, n_texts, levels, n_pairs, order)


def _score(model: Model):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            n, known, base, score = model.score(batch.column(2).to_pylist())
            all_tokens = pa.array(np.full(len(n), model.tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(known), all_tokens, pa.array(base), pa.array(score)], [x.split()[0] for x in COLUMNS.split(", ")])

    return make


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """COLUMNS for every row of docs (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(True)), "text")
    return d.mapInArrow(_score(model), COLUMNS)
