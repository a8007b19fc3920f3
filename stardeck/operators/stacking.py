"""Stacking of frames: averages, medians of five, warped averages and sliding medians.

Frames meet in the row of one plane: rows are shuffled by y, with each frame's row as an array, so the unit of
the shuffle is a row block. Sliding medians look at five frames at a time and hold no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import each_row, matrix, runs, sums_of_rows
from .cuts import drop_folder
from .frames import saturate, to_rows
from .spans import SPAN, numbered

#: Fixed-point steps of a coordinate, and of a sine or cosine (fixed values).
SUB, TURN = 256, 65536


def _rows(frames: DataFrame) -> DataFrame:
    return frames if "row" in frames.columns else to_rows(frames)


def _means(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, v) of sums of rows: the rounded mean where something is there."""
    mean = F.zip_with("s", "n", lambda s, n: F.when(n > 0, F.floor((s + F.floor(n / 2)) / F.when(n > 0, n)).cast("int")))
    return sums.select(*keys, F.posexplode(mean).alias("x", "v")).where("v IS NOT NULL")


def average(frames: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, x, v): the rounded mean of all frames at each pixel. frames: row blocks, or pixels, which are made rows first.

    Rows are summed in each task, then by row; only the result is opened into pixels.
    """
    by = [*keys, "y"]
    return _means(sums_of_rows(_rows(frames).select(*by, "row"), by, each_row(by)), by)


def median_of(values: list[Column]) -> Column:
    return F.element_at(F.sort_array(F.array(*values)), len(values) // 2 + 1)


def average_of_medians(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """(y, x, v): the rounded mean of medians of five frames in a row (by frame number); frames left over are dropped.

    With fewer than five frames in all, their rounded mean. frames: row blocks, or pixels. The five rows of one y meet in a task, and
    their median is summed there.
    """
    rows = _rows(frames).select("frame", "y", "row")
    # one row a frame: numbering them takes frames, not pixels
    order = numbered(rows.select("frame").distinct(), "frame", span=span).select("frame", (F.col("_k") - 1).alias("i"))
    if order.limit(5).count() < 5:
        return average(rows)
    fives = rows.join(order, "frame").select("y", F.expr("i div 5").alias("five"), "i", "row")
    fives = fives.repartition("y", "five").sortWithinPartitions("y", "five", "i")

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        for (y, _), table in runs(batches, ["y", "five"]):
            values, there = matrix(table.column("row").combine_chunks())
            if len(values) == 5:
                yield (y,), np.where(there.all(0), np.sort(values, axis=0)[2], 0), there.all(0)

    return _means(sums_of_rows(fives, ["y"], medians), ["y"])


def fixed(c: Column, k: int) -> Column:
    return F.round(c * k).cast("long")


def source_place(width: int, height: int, dx: Column, dy: Column, angle: Column) -> tuple[Column, Column]:
    """Where in the source, in 1/256 pixels, the pixel (x, y) of the result comes from: turned about the centre and moved."""
    cos, sin = fixed(F.cos(-angle), TURN), fixed(F.sin(-angle), TURN)
    cx, cy = fixed(F.lit((width - 1) / 2), SUB), fixed(F.lit((height - 1) / 2), SUB)
    px, py = F.col("x") * SUB - fixed(dx, SUB) - cx, F.col("y") * SUB - fixed(dy, SUB) - cy
    div = lambda a: _toward_zero(a, TURN)
    return cx + div(px * cos - py * sin), cy + div(py * cos + px * sin)


def _toward_zero(a: Column, by: int) -> Column:
    return F.when(a < 0, -F.shiftright(-a, by.bit_length() - 1)).otherwise(F.shiftright(a, by.bit_length() - 1))


def sample(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """places (keys..., frame, sx, sy in 1/256 pixels) with the bilinear value v of their frame there; null without any corner.

    A corner outside is replaced by its neighbour inside. The whole part is cut toward zero, the rest is taken modulo 256.
    """
    p = places.withColumn("_x", _toward_zero(F.col("sx"), SUB)).withColumn("_y", _toward_zero(F.col("sy"), SUB))
    p = p.withColumn("_u", F.pmod(F.col("sx"), F.lit(SUB))).withColumn("_w", F.pmod(F.col("sy"), F.lit(SUB)))
    # one join with the row above and one with the row below; columns are taken from the row blocks by index
    rows = pixels
    for name, dy in (("_r0", 0), ("_r1", 1)):
        r = rows.select(F.col("frame"), (F.col("y") - dy).cast("long").alias("_y"), F.col("row").alias(name))
        p = p.join(r, ["frame", "_y"], "left")

    def line(row: str) -> Column:
        a = F.when(F.col("_x") >= 0, F.get(F.col(row), F.col("_x").cast("int")))
        b = F.when(F.col("_x") >= -1, F.get(F.col(row), F.col("_x").cast("int") + 1))
        both = a * (SUB - F.col("_u")) + b * F.col("_u")
        return F.coalesce(both, a * SUB, b * SUB)

    top, bottom = line("_r0"), line("_r1")
    v = F.coalesce(top * (SUB - F.col("_w")) + bottom * F.col("_w"), top * SUB, bottom * SUB)
    return p.withColumn("v", saturate(F.shiftright(v, 16))).drop("_x", "_y", "_u", "_w", "_r0", "_r1")


def warp(rows: DataFrame, offsets: DataFrame, width: int, height: int) -> DataFrame:
    """Frames (frame, y, row) turned and moved by offsets (frame, dx, dy, angle): (frame, y, x, v), v null where nothing is."""
    grid = rows.select("frame", "y").join(offsets, "frame").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    sx, sy = source_place(width, height, F.col("dx"), F.col("dy"), F.col("angle"))
    places = grid.select("frame", "y", "x", sx.alias("sx"), sy.alias("sy"))
    return sample(rows, places).select("frame", "y", "x", "v")


def warped_average(rows: DataFrame, offsets: DataFrame, width: int, height: int) -> DataFrame:
    """(y, x, v, cnt): the truncated mean of what frames cover each pixel, 0 where none does."""
    w = warp(rows, offsets, width, height)
    return w.groupBy("y", "x").agg(F.coalesce(saturate(F.expr("sum(v) div nullif(count(v), 0)")), F.lit(0)).alias("v"), F.count("v").alias("cnt"))


#: Places of a quadrilateral that are broadcast (64 MB); more are left to Spark's own size check.
PLACES = 1_000_000


def onto_quad(rows: DataFrame, corners: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """(frame, y, x, v): frames drawn into a quadrilateral of the plane by perspective, each place with the source pixel it falls into; places outside, or in rows that a frame lacks, are left out.

    The places are the same in all frames: they are made once, whatever the number of frames, and each row takes those that fall into it.
    """
    from ..functions.display import quad_matrix

    m = quad_matrix(corners, width, height)
    xs, ys = zip(*corners, strict=True)
    wide, high = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
    # a range of all places and not lines opened into them, whose number Spark would not count
    grid = rows.sparkSession.range(wide * high).select((F.expr(f"id div {wide}") + min(ys)).cast("int").alias("ty"), (F.col("id") % wide + min(xs)).cast("int").alias("tx"))
    at = [m[i][0] * F.col("tx") + m[i][1] * F.col("ty") + m[i][2] for i in range(3)]
    # binary noise must not move what falls on the edge of a pixel
    places = grid.select("ty", "tx", *[F.round(a / at[2], 9).cast("int").alias(c) for a, c in zip(at, "xy", strict=False)])
    places = places.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    met = rows.select("frame", "y", "row").join(F.broadcast(places) if wide * high <= PLACES else places, "y").where(F.col("x") < F.size("row"))
    return met.select("frame", F.col("ty").alias("y"), F.col("tx").alias("x"), F.get("row", F.col("x")).alias("v"))


#: Frames of a row that a task looks at together, beside the four before them.
TOGETHER = 256


def sliding_median(rows: DataFrame, backgrounds: DataFrame, span: int = SPAN) -> DataFrame:
    """(y, x, v, cnt): the mean over five-frame medians, taken from the fifth frame on, less each frame's background and plus the five's.

    rows (frame, y, row), null where the frame covers nothing; backgrounds (frame, background), one row a frame. Row blocks are
    shuffled, by row and TOGETHER frames; what leaves a task are sums for its pixels.
    """
    # a frame's background goes to its own five and to those of the four frames behind it
    k = numbered(backgrounds, "frame", span=span).select("frame", "background", "_k")
    last = F.max(F.when(F.col("_to") == F.col("_k"), F.col("frame"))).alias("frame")
    b = k.withColumn("_to", F.explode(F.sequence("_k", F.col("_k") + 4))).groupBy("_to").agg(last, F.collect_list("background").alias("five"))
    b = b.where("frame IS NOT NULL").where(F.size("five") == 5).select("frame", F.element_at(F.sort_array("five"), F.lit(3)).alias("common"))
    seen = F.transform("row", lambda v: F.when(v.isNotNull(), F.greatest(v, F.lit(1)) - F.col("background")))
    own = F.floor(F.col("_k") / TOGETHER).cast("int")
    p = rows.join(k.join(b, "frame", "left"), "frame").select("y", "_k", "common", seen.alias("d"), own.alias("own"))
    # the last four of a stretch come before the first of the next one, too
    p = p.withColumn("part", F.explode(F.when(F.col("_k") % TOGETHER >= TOGETHER - 4, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy("y", "part").orderBy("_k")
    p = p.select("y", "common", "own", "part", "d", *[F.lag("d", n).over(order).alias(f"d{n}") for n in range(1, 5)]).where("own = part AND common IS NOT NULL")
    half = lambda s: F.when(s < 0, F.ceil(s / 2)).otherwise(F.floor(s / 2)).cast("int")

    def middle(a: Column) -> Column:
        g, n = (lambda i: F.get(a, F.lit(i))), F.size(a)
        return F.when(n == 5, g(2)).when(n == 4, half(g(1) + g(2))).when(n == 3, g(1)).when(n == 2, half(g(0) + g(1))).when(n == 1, g(0)).otherwise(0)

    five = F.transform("d", lambda v, i: F.sort_array(F.array_compact(F.array(v, *[F.get(F.col(f"d{n}"), i) for n in range(1, 5)]))))
    p = p.select("y", "common", five.alias("five"))
    p = p.select("y", F.posexplode(F.transform("five", lambda a: F.greatest(middle(a) + F.col("common"), F.lit(0)))).alias("x", "o"))
    return p.groupBy("y", "x").agg(saturate(F.expr("sum(o) div count(*)")).alias("v"), F.count("*").alias("cnt"))


#: What a stack that grows keeps for each row: sums and counts.
STACK = "y int, s array<long>, n array<long>"


def _each_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    for batch in batches:
        yield from (((y,), s.values.to_numpy(), n.values.to_numpy()) for y, s, n in zip(batch.column("y").to_pylist(), batch.column("s"), batch.column("n"), strict=True))


def add_to_stack(path: str):
    """For foreachBatch over row blocks (frame, y, row): keeps sums and counts of each row in numbered folders under path.

    Batch n reads folder n - 1 and writes folder n, so a batch that runs again writes the same; older folders are removed.
    stacked(path, n) gives the stack after batch n. streaming.live_stack keeps a stack as state instead, and can leave tracks out.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = sums_of_rows(batch.select("y", "row"), ["y"], each_row(["y"]))
        if number:
            new = sums_of_rows(new.unionByName(batch.sparkSession.read.schema(new.schema).parquet(f"{path}/{number - 1}")), ["y"], _each_sum)
        new.write.mode("overwrite").parquet(f"{path}/{number}")
        drop_folder(batch.sparkSession, f"{path}/{number - 2}")

    return write


def stacked(spark, path: str, number: int) -> DataFrame:
    """(y, x, v, cnt): the truncated mean after a batch, as warped_average() has it for what covers a pixel."""
    s = spark.read.schema(STACK).parquet(f"{path}/{number}").select("y", F.posexplode(F.arrays_zip("s", "n")).alias("x", "p")).where("p.n > 0")
    return s.select("y", "x", saturate(F.expr("p.s div p.n")).alias("v"), F.col("p.n").alias("cnt"))
