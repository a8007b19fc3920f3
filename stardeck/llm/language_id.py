"""Language of whole texts by a convolutional network over bytes, trained in numpy on labelled texts.

A window is a fixed number of UTF-8 bytes. Bytes have learned vectors; filters of several widths pass over them, the greatest
value of each filter in the window counts, if positive, and a softmax gives the languages. A text is cut into windows from its
first byte to its last, and its log-probabilities are the means over the windows, weighted by their bytes.

Training reads a bounded number of labelled texts a language. Prediction sends the batches of all texts through tables: as a
filter is a sum of what each byte adds at its place, pairs of bytes are looked up together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import pieces, written

PAD = 0
#: Bytes of the windows and widths of the filters, in bytes; a pair of filter taps is one look-up, so the widest takes two.
WINDOW, WIDTHS, FILTERS, DIM = 128, (2, 3, 4), 16, 8
#: Windows that a worker looks up at once: a few MB of floats.
AT_ONCE = 64
UNKNOWN = "und"
LETTER = "\\p{L}"


@dataclass
class Network:
    """languages, the byte vectors (256, dim), for each width its filters (width, dim, filters) and offsets, and the softmax."""

    languages: list[str]
    window: int = WINDOW
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((256, DIM)))
    filters: list[np.ndarray] = field(default_factory=list)
    offsets: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, *self.filters, *self.offsets, self.weights, self.bias]


def fresh(languages: list[str], seed: int = 7, window: int = WINDOW, widths: tuple[int, ...] = WIDTHS, n: int = FILTERS, dim: int = DIM) -> Network:
    """A network of small random numbers."""
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 0.5, (256, dim))
    vectors[PAD] = 0
    filters = [r.normal(0, np.sqrt(2 / (w * dim)), (w, dim, n)) for w in widths]
    weights = r.normal(0, 0.1, (n * len(widths), len(languages)))
    return Network(languages, window, vectors, filters, [np.zeros(n) for _ in widths], weights, np.zeros(len(languages)))


def windows_of(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, bytes): each text's UTF-8 in rows of `size` bytes, the last filled with PAD, A-Z lower-cased and zero bytes blank.

    owner is the index of the row's text. A null or empty text has no row; all other bytes are in one row each.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower().replace(b"\0", b" ") for t in texts]
    rows = np.array([-(-len(b) // size) for b in raw], np.int64)
    flat = np.frombuffer(b"".join(b.ljust(int(n) * size, b"\0") for b, n in zip(raw, rows, strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(raw)), rows)
    filled = np.full(len(owner), size, np.int64)
    ends = np.cumsum(rows)[rows > 0] - 1
    filled[ends] = np.array([len(b) for b in raw], np.int64)[rows > 0] - (rows[rows > 0] - 1) * size
    return flat.reshape(-1, size), owner, filled


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def forward(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(log-probabilities, pooled values, where each filter's greatest value begins), as the definition has it."""
    x = net.vectors[windows]
    pooled, places = [], []
    for f, b in zip(net.filters, net.offsets, strict=True):
        w = len(f)
        seen = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)  # (rows, places, dim, width)
        values = seen.transpose(0, 1, 3, 2).reshape(len(x), -1, f.shape[0] * f.shape[1]) @ f.reshape(-1, f.shape[2])
        at = values.argmax(1)
        places.append(at)
        pooled.append(np.take_along_axis(values, at[:, None], 1)[:, 0] + b)
    h = np.concatenate(pooled, 1) if pooled else np.zeros((len(x), 0))
    return _log_softmax(np.maximum(h, 0) @ net.weights + net.bias), h, places


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss and its gradients, in the order of Network.parameters(). Only a filter's greatest place has one."""
    logs, h, places = forward(net, windows)
    n = len(windows)
    d = np.exp(logs)
    d[np.arange(n), labels] -= 1
    d /= n
    d_weights, d_bias = np.maximum(h, 0).T @ d, d.sum(0)
    d_h = (d @ net.weights.T) * (h > 0)
    d_vectors, d_filters, d_offsets, at = np.zeros_like(net.vectors), [], [], 0
    for f, place in zip(net.filters, places, strict=True):
        k = f.shape[2]
        g = d_h[:, at : at + k]
        at += k
        d_f = np.zeros_like(f)
        for j in range(len(f)):
            met = np.take_along_axis(windows, place + j, 1)  # (rows, filters): the byte under tap j
            d_f[j] = np.einsum("nkd,nk->dk", net.vectors[met], g)
            np.add.at(d_vectors, met.reshape(-1), (g[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1]))
        d_filters.append(d_f)
        d_offsets.append(g.sum(0))
    d_vectors[PAD] = 0
    loss = -float(logs[np.arange(n), labels].mean())
    return loss, [d_vectors, *d_filters, *d_offsets, d_weights, d_bias]


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7, net: Network | None = None) -> Network:
    """A network fitted to labelled windows by Adam; languages count alike, however many windows each has. The same rows give the same network."""
    net = net or fresh(languages, seed)
    r = np.random.default_rng(seed)
    groups = [np.flatnonzero(labels == k) for k in range(len(languages))]
    most = max(map(len, groups))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(np.concatenate([np.resize(r.permutation(g), most) for g in groups]))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, found = gradients(net, windows[rows], labels[rows])
            step += 1
            speed = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, (m, v), g in zip(net.parameters(), state, found, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= speed * m / (np.sqrt(v) + 1e-8)
    return net


class Tables:
    """The network's filters as look-ups: what a pair of bytes adds to each filter at its first, and at its second, two places."""

    def __init__(self, net: Network):
        widths = {len(f) for f in net.filters}
        if not widths <= {2, 3, 4}:
            raise ValueError("filters are two to four bytes wide")
        self.net, self.wide = net, net.filters[0].shape[2]
        order = sorted(range(len(net.filters)), key=lambda k: len(net.filters[k]))
        taps = [np.einsum("bd,wdk->wbk", net.vectors, net.filters[k]) for k in order]
        first = [t[0][:, None] + t[1][None] for t in taps]
        second = [t[2][:, None] + (t[3][None] if len(t) == 4 else 0 * t[2][None]) for t in taps if len(t) > 2]
        self.first = np.concatenate(first, 2).reshape(65536, -1).astype(np.float32)
        self.second = np.concatenate(second, 2).reshape(65536, -1).astype(np.float32) if second else None
        self.lengths = [len(t) for t in taps]
        at = np.argsort(order)  # columns back to the order of net.filters
        self.back = np.concatenate([np.arange(self.wide) + k * self.wide for k in at])

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """As forward() pools, but for the rounding of 32-bit floats."""
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        values = np.take(self.first, pairs, axis=0)
        if self.second is not None:
            later = np.take(self.second, pairs[:, 2:], axis=0)
            values[:, :-2, values.shape[2] - later.shape[2] :] += later
        # up to the last place of a filter of four bytes all filters are whole; shorter ones have one or two places more
        out = values[:, :-2].max(1)
        for k, w in enumerate(self.lengths):
            own = slice(k * self.wide, (k + 1) * self.wide)
            if w == 2:
                out[:, own] = np.maximum(out[:, own], values[:, -2:, own].max(1))
            elif w == 3:
                at = own.start - values.shape[2] + self.second.shape[1]
                last = self.second[windows[:, -1].astype(np.int32) << 8 | PAD, at : at + self.wide]
                out[:, own] = np.maximum(out[:, own], values[:, -2, own] + last)
        return out[:, self.back]

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.pooled(windows[at : at + AT_ONCE]) for at in range(0, len(windows), AT_ONCE)]) if len(windows) else np.zeros((0, len(self.back)))
        h = np.maximum(h + np.concatenate(self.net.offsets), 0)
        return _log_softmax(h @ self.net.weights + self.net.bias)

    def languages_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, its probability) for each text; a text without bytes has the network's own leaning."""
        windows, owner, filled = windows_of(texts, self.net.window)
        logs = self.log_probabilities(windows) * filled[:, None]
        sums = np.stack([np.bincount(owner, logs[:, k], len(texts)) for k in range(logs.shape[1])], 1)
        means = _log_softmax(sums / np.maximum(np.bincount(owner, filled, len(texts)), 1)[:, None])
        best = means.argmax(1)
        return best, np.exp(means[np.arange(len(texts)), best])


def _windows(size: int, each: int, schema: pa.Schema):
    """Up to `each` windows of every text, spread evenly from its first to its last; each fourth is cut short."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, h, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "h", "text")], strict=True):
                windows, _, _ = windows_of([text], size)
                for k in sorted({i * (len(windows) - 1) // max(each - 1, 1) for i in range(each)}):
                    w = windows[k].tobytes()
                    out.append((lang, h, k, w if k % 4 != 3 else w[: size // 8 + (h + k) % (size // 2)].ljust(size, b"\0")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return make


def sample(docs: DataFrame, allowed: Column, texts: int = 250) -> DataFrame:
    """(lang, h, text): at most `texts` different texts of each language, of rows for which `allowed` holds, the first by h, their hash.

    Rows without a letter, a text or a language are none, and nor is a text that has more than one language. Hashes are
    counted once however many copies there are, and only those below a bound that leaves about twice `texts` are ranked, so no task
    holds a language.
    """
    d = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    one = d.groupBy("h").agg(F.min("lang").alias("lang"), F.max("lang").alias("also")).where("lang = also").select("lang", "h")
    one = written(one, "texts-by-language")
    bound = -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), (2.0 * texts + 100) / F.col("n"))
    # a row a language: less than the network, which has weights for each and goes to every task as well
    near = one.join(F.broadcast(one.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where(F.col("h").cast("double") <= bound)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= texts)
    # at most `texts` hashes a language
    return d.join(F.broadcast(first.select("lang", "h")), ["lang", "h"]).dropDuplicates(["lang", "h"])


def train(docs: DataFrame, allowed: Column, texts: int = 250, each: int = 6, epochs: int = 5, window: int = WINDOW) -> Network | None:
    """A network for the languages of docs (text, lang); None if no row can be learned from.

    At most `texts` texts of a language and `each` windows of a text reach the driver, where it is fitted: a bound that does
    not grow with docs. `allowed` is a condition on docs.
    """
    schema = "lang string, h long, k int, window binary"
    rows = sample(docs, allowed, texts).mapInArrow(_windows(window, each, to_arrow_schema(StructType.fromDDL(schema))), schema)
    found = sorted((r["lang"], r["h"], r["k"], bytes(r["window"])) for r in rows.collect())
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    place = {x: k for k, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(r[3] for r in found), np.uint8).reshape(-1, window)
    return fit(windows, np.array([place[r[0]] for r in found]), languages, epochs, net=fresh(languages, window=window))


def _predict(net: Network, names: list[str]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(net)
        known = pa.array([*net.languages, UNKNOWN])
        for batch in pieces(batches, 2, size=2_000_000):
            texts = batch.column(2)
            best, score = tables.languages_of(texts.to_pylist())
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            best, score = np.where(missing, len(net.languages), best), np.where(missing, 0.0, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), known.take(pa.array(best)), pa.array(score), *batch.columns[3:]], names)

    return make


def predict(docs: DataFrame, net: Network | None, held_out: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns `carry` for every row of docs (doc_id, text); no other column is looked at.

    lang_pred is one of the network's languages and score its probability. A text that is null or has no letter, and any text
    where there is no network, is `und` with score 0. Rows stand by themselves: null, repeated ids and equal texts make no
    difference. held_out is true where the condition is null.
    """
    also = [f"_{k}" for k in range(len(carry))]
    text = F.when(F.col("text").rlike(LETTER), F.col("text"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), text.alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, also, strict=True)])
    if net is None:
        out = d.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *also)
    else:
        names = ["doc_id", "held_out", "lang_pred", "score", *also]
        schema = "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in also)
        out = d.mapInArrow(_predict(net, names), schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(k).alias(c) for k, c in zip(also, carry, strict=True)])
