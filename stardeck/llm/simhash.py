"""SimHash near-duplicates: fingerprints compared exactly, tile by tile, with numpy.

Equal fingerprints are first grouped. The others are dealt into cells by the population counts of their
four 16-bit quarters. Two fingerprints that differ in at most r bits have counts that differ, summed over
the quarters, by at most r: so only cells that near one another are compared, and all other tile pairs are
skipped. Cells are cut into tiles of bounded size, and a cell's tiles into strips of at most `strip`; a tile is
sent to the strips that it may meet, so a full cell is compared by as many tasks as it has strips. A tile
pair is one row with both tiles packed, compared by exclusive-or and bit counts. Of a tile pair's links only a
spanning forest leaves the task, so a group of n linked fingerprints makes at most n - 1 rows for each tile
pair and never all pairs.

Cases: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle
has make one shingle; repeated rows and ids are grouped; a null id takes part but never names a component
unless its whole group is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEED, pieces, words_of, written
from .components import components

QUARTERS = 4
#: 17 counts in each of four quarters: so many cells there can be, whatever the input.
MOST_CELLS = 17**QUARTERS


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text."""
    words = words_of(text)
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    cut = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([digest(joined[a:b], SEED) for a, b in cut], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big")


def _fingerprints(shingle: int):
    """A column's fingerprints: only texts go to Python and only numbers come back. Said to be nondeterministic, so that Spark asks each text once."""

    @F.arrow_udf("long")
    def prints(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 0)
            found = np.array([fingerprint(t, shingle) for part in parts for t in part.column(0).to_pylist()], np.uint64)
            yield pa.array(found.view(np.int64))

    return prints.asNondeterministic()


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that join what lies within the radius in tiles a and b as all pairs would."""
    nodes = a if same else np.concatenate([a, b])
    label = np.arange(len(nodes))
    near_a, near_b = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        near_a.append(i + at)
        near_b.append(j + (0 if same else len(a)))
    i, j = np.concatenate(near_a), np.concatenate(near_b)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b, same in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x, y = forest(np.array(a, np.int64).view(np.uint64), np.array(b, np.int64).view(np.uint64), radius, same)
                left.append(x.view(np.int64))
                right.append(y.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["a", "b"])

    return make


def links(prints: DataFrame, radius: int, tile: int = 2048, strip: int = 8) -> DataFrame:
    """(a, b) of fingerprints, linked as all pairs of the distinct `fp` within the radius would link them."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) for k in range(QUARTERS)]
    cell = sum((q * 17**k for k, q in enumerate(quarter)), F.lit(0)).cast("int")
    prints = prints.select("fp", cell.alias("cell"))
    # at most MOST_CELLS rows: a bound that no input exceeds, so the counts may be broadcast
    tiles_of = F.broadcast(written(prints.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("n_tiles")), "cells"))
    dealt = prints.join(tiles_of, "cell")
    tiles = dealt.groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int").alias("tile")).agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles.withColumn("strip", F.floor(F.col("tile") / strip).cast("int")), "tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]
    count = [(F.col("cell") / 17**k).cast("int") % 17 for k in range(QUARTERS)]
    near = [
        F.when(
            F.expr("true") if not any(d) else _within(count, d),
            F.col("cell") + sum(x * 17**k for k, x in enumerate(d)),
        )
        for d in steps
    ]
    probes = tiles.select(F.col("tile").alias("t"), F.col("cell").alias("c"), F.col("fps").alias("x"), F.explode(F.array_compact(F.array(*near))).alias("cell"))
    last = F.floor((F.col("n_tiles") - 1) / strip).cast("int")
    probes = probes.join(tiles_of, "cell").select("t", "c", "x", "cell", F.explode(F.sequence(F.lit(0), last)).alias("strip"))
    pairs = probes.join(tiles, ["cell", "strip"]).where("c <> cell OR t <= tile")
    return pairs.select("x", "fps", (F.expr("c = cell AND t = tile")).alias("same")).mapInArrow(_compare(radius), "a long, b long")


def _within(count: list, d: tuple) -> Column:
    inside = F.lit(True)
    for c, x in zip(count, d, strict=True):
        if x:
            inside = inside & (c + x).between(0, 16)
    return inside


def _printed(docs: DataFrame, shingle: int, id_col: str, text_col: str, carry: tuple[Column, ...] = ()) -> DataFrame:
    """(fp, row, doc_id, _0, _1, ...), written: a row for each row of docs, numbered, with the columns `carry`."""
    also = [c.alias(f"_{k}") for k, c in enumerate(carry)]
    d = docs.select(_fingerprints(shingle)(F.col(text_col)).alias("fp"), F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), *also)
    return written(d, "fingerprints")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, group, component_id), written: the group of each fingerprint, and the least id in it."""
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # fingerprints as nodes; the component's least id comes from its groups' least ids
    found = components(links(groups, radius))
    named = found.join(groups, found["node"] == groups["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = found.join(named, "component").select(F.col("node").alias("fp"), F.col("component").alias("group"), "component_id")
    of_group = groups.join(linked, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    return written(of_group, "of-group")  # read anew, it leaves Spark free to split a fingerprint that many rows have


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least id reachable) for every row of docs."""
    prints = _printed(docs, shingle, id_col, text_col)
    return prints.join(_grouped(prints, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with the columns of docs: that of the smallest id, nulls last.

    Of rows that share that id the one whose text has the smallest hash stays; of equal rows any.
    """
    columns = docs.columns
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    prints = _printed(docs, shingle, id_col, text_col, (*[F.col(c) for c in columns], tie))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(f"_{len(columns)}").alias("tie"), "row")
    ranked = prints.select("fp", "row", order.alias("o")).join(_grouped(prints, radius).select("fp", "group"), "fp")
    first = ranked.groupBy("group").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    # few rows go as a rule: their numbers are what the texts are joined with
    gone = written(prints.select("row").join(first, "row", "left_anti"), "gone")
    return prints.join(gone, "row", "left_anti").select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(columns)])
