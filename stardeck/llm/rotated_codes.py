"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are taken relative to a centre (the mean of a bounded sample), rotated by a random orthogonal
matrix and reduced to one sign bit a component. With code x = sign / sqrt(D), unit residual o and
correction c = <x, o>, <x, q> / c estimates <o, q> with an error of about sqrt((1 - c^2) / c^2) / sqrt(D - 1).
Inner products come from the packed bits: 256 partial sums for each byte of the code are laid out once for
a query. Candidates whose lower bound of the distance lies within the distance that has already been
reached are measured exactly, in double precision on the original vectors.

All vectors are indexed, in shards of bounded size; queries come in blocks of bounded size; a row holds one
block and one shard. Each gives its own nearest, which a window ranks for each query.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null id; vectors of different lengths are not compared; repeated ids with the query's id are the
query's own rows; rows that repeat id and vector count once, before anything is cut; fewer candidates than
asked for give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FOUND = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual norms and corrections of the rows of x."""
    away = x - centre
    norm = np.linalg.norm(away, axis=1)
    unit = (away / np.where(norm == 0, 1, norm)[:, None]) @ turn
    bits = unit > 0
    correction = np.where(bits, unit, -unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), norm, np.where(norm == 0, 1, correction)


def _tables(q: np.ndarray, width: int) -> np.ndarray:
    """For every byte of a code and each of its 256 values, the sum of sign times component."""
    padded = np.zeros(8 * width)
    padded[: len(q)] = q
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
    return padded.reshape(width, 8) @ signs.T


def nearest(queries: tuple, shard: tuple, turn: np.ndarray, centre: np.ndarray, k: int, eps: float) -> Iterator[tuple]:
    """(query id, ids, distances) of the k nearest of the shard for each query, by code, bound and exact measure."""
    ids, x, codes, norm, corr = shard
    d = x.shape[1]
    spread = eps * np.sqrt(np.maximum(1 - corr**2, 0)) / corr / np.sqrt(max(d - 1, 1))
    for qid, q in zip(*queries, strict=True):
        r = (q - centre) @ turn
        length = np.linalg.norm(r)
        table = _tables(r, codes.shape[1])
        inner = table[0][codes[:, 0]]
        for b in range(1, codes.shape[1]):
            inner = inner + table[b][codes[:, b]]
        # squared distance = norm^2 + length^2 - 2 norm <o, r>; the estimate, and how far below it the truth may be
        estimate = norm**2 + length**2 - 2 * norm * inner / np.sqrt(d) / corr
        least = estimate - 2 * norm * length * spread
        mine = ids != qid
        few = min(k, int(mine.sum()))
        if not few:
            continue
        first = np.argpartition(np.where(mine, estimate, np.inf), few - 1)[:few]
        reached = _exact(x[first], q).max()
        chosen = np.nonzero(mine & (least <= reached**2 * (1 + 1e-12)))[0]
        chosen = np.union1d(chosen, first)
        found, dist = _different(ids[chosen], _exact(x[chosen], q))
        if (dist <= reached).sum() < few:  # an id has several vectors at one distance: `first` holds fewer neighbours than rows
            found, dist = _different(ids[mine], _exact(x[mine], q))
        yield qid, found[:k], dist[:k]


def _different(ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of id and distance, nearest first."""
    order = np.lexsort((ids, dist))
    ids, dist = ids[order], dist[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (dist[1:] != dist[:-1])
    return ids[new], dist[new]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _matrix(column: pa.Array, row: int, d: int) -> np.ndarray:
    return np.frombuffer(column[row].as_py(), np.float64).reshape(-1, d)


def _search(centres: dict[int, list[float]], k: int, eps: float, seed: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {d: rotation(d, seed) for d in centres}
        for batch in batches:
            for row in range(batch.num_rows):
                d = batch.column(0)[row].as_py()
                qids, ids, = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in (1, 3))
                q, x = (_matrix(batch.column(c), row, d) for c in (2, 4))
                codes = np.frombuffer(batch.column(5)[row].as_py(), np.uint8).reshape(len(ids), -1)
                norm, corr = (np.frombuffer(batch.column(c)[row].as_py(), np.float64) for c in (6, 7))
                out = [[], [], []]
                for qid, found, dist in nearest((qids, q), (ids, x, codes, norm, corr), turns[d], np.array(centres[d]), k, eps):
                    out[0].append(np.full(len(found), qid))
                    out[1].append(found)
                    out[2].append(dist)
                columns = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return make


def _packed(rows: DataFrame, size: int, part: str, counts: dict[int, int]) -> DataFrame:
    """(d, part, vecs): rows of each dimension dealt into parts of about `size`, by the hash of their ids."""
    n = F.lit(1)
    for d, c in counts.items():
        n = F.when(F.col("d") == d, max(1, -(-c // size))).otherwise(n)
    dealt = rows.withColumn(part, F.pmod(F.xxhash64("id", "v"), n.cast("long")).cast("int"))
    return dealt.groupBy("d", part).agg(F.collect_list(F.struct("id", "v")).alias("vecs"))


def _flatten(centres: dict[int, list[float]], seed: int, coded: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {d: rotation(d, seed) for d in centres}
        for batch in batches:
            for row in range(batch.num_rows):
                d, part = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                held = batch.column(2)[row].values
                ids = held.field("id").to_numpy(zero_copy_only=False)
                x = held.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                made = encode(x, np.array(centres[d]), turns[d]) if coded else ()
                packed = [np.ascontiguousarray(a).tobytes() for a in (ids, x, *made)]
                names = ["d", "part", "ids", "x", "codes", "norm", "corr"][: 4 + len(made)]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), *[pa.array([b], pa.binary()) for b in packed]], names)

    return make


def _different_rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part, those that repeat both once. Repeats would use up the places of a shard's nearest."""
    rows = rows.where(usable(vector_col) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropDuplicates(["id", "v"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, eps: float = 3.0, shard: int = 8192, block: int = 2048, sample: int = 4096, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `vectors` for each row of `queries`, its own id aside.

    eps: standard errors that the bound allows for; sample: rows that the centre is fitted on (the first by
    hash of id); shard and block: vectors and queries in a row of the comparison.
    """
    rows = written(_different_rows(vectors, id_col, vector_col), "vectors")
    rows, asked = (r.select("id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("d")) for r in (rows, _different_rows(queries, id_col, vector_col)))
    counts = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}
    wanted = {r["d"]: r["count"] for r in asked.groupBy("d").count().collect()}
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("d", F.posexplode("v")).groupBy("d", "pos").agg(F.avg("col").alias("m")).collect()
    centres: dict[int, list[float]] = {d: [0.0] * d for d in counts}
    for r in fitted:
        centres[r["d"]][r["pos"]] = r["m"]
    code = "d int, part int, ids binary, x binary"
    shards = _packed(rows, shard, "part", counts).mapInArrow(_flatten(centres, seed, True), f"{code}, codes binary, norm binary, corr binary")
    shards = written(shards, "codes")
    n_parts = F.lit(1)
    for d, c in counts.items():
        n_parts = F.when(F.col("d") == d, max(1, -(-c // shard))).otherwise(n_parts)
    blocks = _packed(asked, block, "part", wanted).mapInArrow(_flatten(centres, seed, False), code)
    blocks = blocks.select("d", F.col("ids").alias("qids"), F.col("x").alias("q"), F.explode(F.sequence(F.lit(0), n_parts.cast("int") - 1)).alias("part"))
    pairs = blocks.hint("shuffle_hash").join(shards, ["d", "part"]).select("d", "qids", "q", "ids", "x", "codes", "norm", "corr")
    found = pairs.mapInArrow(_search(centres, k, eps, seed), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
