"""Arithmetic on row blocks in Arrow batches: bands of a frame with their neighbouring rows, and sums of whole rows.

A stencil over rows deals each frame in bands of rows; the rows next to a band go to both sides, so bands are worked on by
themselves and a frame is spread over as many tasks as it has bands. Sums of rows are made in each task first, and meet by row
number as arrays. Pixels never travel alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import CFA, MAX16

#: Rows of a band, and bytes of sums that a task holds before it passes them on.
BAND, HELD = 64, 64_000_000


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are there) of lists, filled with zeros to the longest."""
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    there = np.arange(width)[None] < lengths[:, None]
    flat = rows.drop_null().flatten() if rows.null_count else rows.flatten()
    out = np.zeros(there.shape, np.int64)
    out[there] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return out, there


def lists(values: np.ndarray, there: np.ndarray | None = None, kind: pa.DataType = pa.int32()) -> pa.Array:
    """The rows of a matrix as lists, null where nothing is there."""
    flat = pa.array(values.ravel(), kind, mask=None if there is None or there.all() else ~there.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, which come one after another."""
    last, held = None, []
    for batch in batches:
        at = 0
        for key, run in groupby(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
            n = sum(1 for _ in run)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, n))
            last, at = key, at + n
    if held:
        yield last, pa.Table.from_batches(held)


def colours(cfa: str | None, y0: int, height: int, width: int) -> np.ndarray:
    """The letter of each pixel from row y0 on; L without a pattern."""
    if cfa is None:
        return np.full((height, width), "L")
    two = np.array([list(r) for r in CFA[cfa]])
    return two[(y0 + np.arange(height))[:, None] % 2, np.arange(width)[None] % 2]


class Band:
    """Rows from y0 on, with their neighbours: values and what is there, both with `halo` more pixels on the left and right."""

    def __init__(self, key: tuple, table: pa.Table, halo: int, band: int):
        t = table.combine_chunks()
        ys = t.column("y").to_numpy().astype(np.int64)
        self.frame, self.halo, self.table = key[0], halo, t
        values, there = matrix(t.column("row").combine_chunks())
        first = key[1] * band
        self.y0 = first - halo
        self.values = np.zeros((band + 2 * halo, values.shape[1] + 2 * halo), np.int64)
        self.there = np.zeros(self.values.shape, bool)
        at = ys - self.y0
        inside = slice(halo, halo + values.shape[1])
        self.values[at, inside], self.there[at, inside] = values, there
        self.own = (ys >= first) & (ys < first + band)
        self.rows, self.ys, self.width = at[self.own], ys[self.own], values.shape[1]

    def shifted(self, a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        """a, moved so that what is (dy, dx) away lies on each pixel of the band's own rows."""
        return a[self.rows + dy][:, self.halo + dx : self.halo + dx + self.width]

    def mean(self, near: list[tuple[int, int]]) -> np.ndarray:
        """The rounded mean of what is there of these neighbours; 0 of none."""
        s, n = self.sums(near)
        return (s + n // 2) // np.maximum(n, 1)

    def sums(self, near: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        s, n = np.zeros((len(self.rows), self.width), np.int64), np.zeros((len(self.rows), self.width), np.int64)
        for dy, dx in near:
            m = self.shifted(self.there, dy, dx)
            s += np.where(m, self.shifted(self.values, dy, dx), 0)
            n += m
        return s, n

    def colour(self, cfa: str | None) -> np.ndarray:
        return colours(cfa, self.y0, len(self.values), self.width)[self.rows]


def by_bands(rows: DataFrame, halo: int, make: Callable[[Band], pa.RecordBatch], schema: str, band: int = BAND) -> DataFrame:
    """make() of every band of row blocks (frame, y, row and more), each with `halo` rows above and below. make gives columns of `schema`."""
    of = lambda y: F.floor(y / band).cast("int")
    parts = F.explode(F.sequence(of(F.col("y") - halo), of(F.col("y") + halo)))
    dealt = rows.select("*", parts.alias("_band")).repartition("frame", "_band").sortWithinPartitions("frame", "_band", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in runs(batches, ["frame", "_band"]):
            b = Band(key, table, halo, band)
            if len(b.rows):
                yield make(b)

    return dealt.mapInArrow(run, schema)


# --- sums of rows -----------------------------------------------------------------------------------------------------


class _Sums:
    """Sums and counts by key, passed on when they take too much memory."""

    def __init__(self, keys: list[str], schema: pa.Schema):
        self.keys, self.schema = keys, schema
        self.held: dict[tuple, list[np.ndarray]] = {}
        self.size = 0

    def add(self, key: tuple, s: np.ndarray, n: np.ndarray) -> None:
        old = self.held.get(key)
        if old is None:
            self.held[key] = [s.astype(np.int64), n.astype(np.int64)]
            self.size += 16 * len(s)
            return
        for k, new in enumerate((s, n)):
            if len(new) > len(old[k]):
                old[k] = np.pad(old[k], (0, len(new) - len(old[k])))
            old[k][: len(new)] += new

    def out(self) -> pa.RecordBatch:
        columns = [pa.array(c, self.schema.field(k).type) for k, c in zip(self.keys, zip(*self.held, strict=True), strict=True)]
        sums = [pa.array([v[k] for v in self.held.values()], pa.list_(pa.int64())) for k in (0, 1)]
        self.held, self.size = {}, 0
        return pa.RecordBatch.from_arrays([*columns, *sums], schema=self.schema)

    def full(self) -> bool:
        return self.size > HELD


def sums_of_rows(parts: DataFrame, keys: list[str], pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(keys, s, n): sums and counts of rows, for (key, sums, counts) that `pieces` makes of a task's batches.

    Each task sums what it has of a key, then the sums meet by key: rows, not pixels, are shuffled.
    """
    key_schema = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_schema}, s array<long>, n array<long>"
    arrow_schema = arrow(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(keys, arrow_schema)
        for key, s, n in pieces(batches):
            sums.add(key, s, n)
            if sums.full():
                yield sums.out()
        if sums.held:
            yield sums.out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(keys, arrow_schema)
        for batch in batches:
            rows = zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column("s"), batch.column("n"), strict=True)
            for key, s, n in rows:
                if sums.full() and key not in sums.held:
                    yield sums.out()
                sums.add(key, s.values.to_numpy(), n.values.to_numpy())
        if sums.held:
            yield sums.out()

    met = parts.mapInArrow(partial, schema).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(merged, schema)


def each_row(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple, np.ndarray, np.ndarray]]]:
    """For sums_of_rows(): every row (keys, row) as it is, its nulls left out."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        for batch in batches:
            values, there = matrix(batch.column("row"))
            yield from zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), values, there, strict=True)

    return pieces


def value_counts(rows: DataFrame, values: Callable[[int, np.ndarray, np.ndarray], Iterator[tuple[str, np.ndarray]]]) -> DataFrame:
    """(frame, chan, v, freq): histograms of what values(y, row, there) gives of each row as (channel, values). Counted in tasks first."""
    schema = "frame long, chan string, v int, freq long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list[np.ndarray]] = {}
            image, there = matrix(batch.column("row"))
            for frame, y, row, has in zip(batch.column("frame").to_pylist(), batch.column("y").to_pylist(), image, there, strict=True):
                for chan, v in values(y, row, has):
                    found.setdefault((frame, chan), []).append(v)
            for (frame, chan), v in found.items():
                u, n = np.unique(np.concatenate(v), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([frame] * len(u), pa.int64()), pa.array([chan] * len(u)), pa.array(u, pa.int32()), pa.array(n, pa.int64())], ["frame", "chan", "v", "freq"])

    h = rows.select(F.col("frame").cast("long"), F.col("y").cast("int"), "row").mapInArrow(counted, schema)
    return h.groupBy("frame", "chan", "v").agg(F.sum("freq").alias("freq"))


def clipped(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0, MAX16)
