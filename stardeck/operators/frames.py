"""Frames as relations, their histograms and statistics.

A frame is kept in row blocks (frame, y, row ARRAY<INT>), thousands of records and not millions for a
sensor; the long form (frame, y, x, v) is made where an operator needs single pixels. Every function takes
a `frame` key, so that any number of frames is worked on together and partial aggregation comes first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours of the 2 x 2 sensor patterns, by row and column parity (fixed values).
CFA = {"RGGB": ("RG", "GB"), "BGGR": ("BG", "GR"), "GRBG": ("GR", "BG"), "GBRG": ("GB", "RG")}
MAX16 = 65535


def rows_of_vectors(vectors: DataFrame, height: int = 50) -> DataFrame:
    """Row blocks from a table of vectors: each vector is one sensor row, `height` of them a frame."""
    value = lambda e: F.floor((e.cast("double") + 1.0) * 32767.5).cast("int")
    return vectors.select(
        F.expr(f"vec_id div {height}").alias("frame"),
        F.expr(f"cast(vec_id % {height} as int)").alias("y"),
        F.transform("embedding", value).alias("row"),
    )


def to_pixels(rows: DataFrame) -> DataFrame:
    return rows.select("frame", "y", F.posexplode("row").alias("x", "v"))


def to_rows(pixels: DataFrame) -> DataFrame:
    row = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"])
    return pixels.groupBy("frame", "y").agg(row.alias("row"))


def color(cfa: str | None, y: str = "y", x: str = "x") -> Column:
    """The colour of a pixel under a pattern; "L" without one."""
    if cfa is None:
        return F.lit("L")
    (a, b), (c, d) = CFA[cfa]
    even, left = F.pmod(F.col(y), F.lit(2)) == 0, F.pmod(F.col(x), F.lit(2)) == 0
    return F.when(even & left, a).when(even, b).when(left, c).otherwise(d)


def saturate(c: Column, top: int = MAX16) -> Column:
    """c within 0 and top; null stays null, which least() and greatest() alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(top), c))).cast("int")


def rect(rows: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """The pixels of a rectangle, both ends in it, clipped to the frame. Rows are filtered before they are opened."""
    part = rows.where(F.col("y").between(y1, y2))
    first = max(x1, 0)
    cut = F.slice("row", first + 1, max(x2 - first + 1, 0))
    return part.select("frame", "y", F.posexplode(cut).alias("dx", "v")).select("frame", "y", (F.col("dx") + first).alias("x"), "v")


def histogram(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys..., v, freq); partial counts are made before the shuffle."""
    return pixels.groupBy(*keys, "v").agg(F.count("*").alias("freq"))


def sampled(pixels: DataFrame, width: int, step: int) -> DataFrame:
    """Every step-th pixel of the linear sequence."""
    return pixels.where(F.pmod(F.col("y").cast("long") * width + F.col("x"), F.lit(step)) == 0)


def moments(hist: DataFrame, *keys: str, top: int = MAX16) -> DataFrame:
    """count, mean and population deviation of a histogram; values over `top` don't count."""
    sums = hist.where(F.col("v") <= top).groupBy(*keys).agg(
        F.sum("freq").alias("count"),
        F.sum(F.col("v") * F.col("freq")).alias("s"),
        F.sum(F.col("v").cast("long") * F.col("v") * F.col("freq")).alias("ss"),
    )
    n, s, ss = (F.col(c).cast("double") for c in ("count", "s", "ss"))
    return sums.select(*keys, "count", (s / n).alias("mean"), F.sqrt(F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0))).alias("std_dev"))


def median_rank(n: Column) -> Column:
    return F.floor(n / 2)


def percentile_rank(percent: float, n: Column) -> Column:
    """The 0-based rank of a percentile: (percent x count, truncated, + 50) / 100."""
    return F.floor((F.floor(n * percent) + 50) / 100)


def ranked(hist: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """For each key, the value at each 0-based rank (a function of column `count`); past the end 65535.

    The running sum is over a histogram, which has at most 65,536 rows for each key, whatever the frame.
    """
    order = Window.partitionBy(*keys).orderBy("v")
    cum = hist.withColumn("cum", F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.withColumn("count", F.sum("freq").over(Window.partitionBy(*keys)))
    at = [F.coalesce(F.min(F.when(F.col("cum") > r, F.col("v"))), F.lit(MAX16)).alias(name) for name, r in ranks.items()]
    return cum.groupBy(*keys).agg(*at)


def background(pixels: DataFrame) -> DataFrame:
    """The truncated mean of each frame."""
    return pixels.groupBy("frame").agg(F.expr("cast(sum(v) div count(*) as int)").alias("background"))


def plane_noise(pixels: DataFrame, width: int) -> DataFrame:
    """Noise of each frame: every 7th 11-tuple of the linear sequence, centre against the mean of the others, RMS of the lowest 80 %."""
    p = pixels.select("frame", "v", (F.col("y").cast("long") * width + F.col("x")).alias("pos"))
    p = p.select("frame", "v", F.expr("pos div 11").alias("t"), F.expr("pos % 11").alias("k")).where("t % 7 = 0")
    t = p.groupBy("frame", "t").agg(F.sum("v").alias("s"), F.max(F.when(F.col("k") == 5, F.col("v"))).alias("m"), F.count("*").alias("n")).where("n = 11")
    d = t.select("frame", F.abs(F.col("m") - F.expr("(s - m + 5) div 10")).alias("v"))
    # the lowest 80 % by a histogram of differences: bounded rows to a frame, no sort of all tuples in one task
    order = Window.partitionBy("frame").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(d, "frame").withColumn("cum", F.sum("freq").over(order))
    h = h.withColumn("top", F.floor(80 * F.sum("freq").over(Window.partitionBy("frame")) / 100))
    taken = F.greatest(F.least(F.col("freq"), F.col("top") - F.col("cum") + F.col("freq")), F.lit(0))
    return h.groupBy("frame").agg(F.sqrt(F.sum(F.col("v") * F.col("v") * taken) / F.max("top")).alias("noise"))


def clipped_noise(rows: DataFrame, width: int, height: int, rounds: int = 5, keep: Column | None = None) -> DataFrame:
    """Noise of raw frames: every 7th cell of a grid, up to five rounds of clipping above median + 3 sigma, RMS about the cells' means.

    Cells have at most 42 x 42 values; each is clipped by itself, in Arrow batches of cells.
    """
    size = min(max(width // 200, 16), 42)
    # only the rows and columns of chosen cells are opened
    part = rows.where((F.expr(f"(y div {size}) % 7") == 0) & (F.col("y") < size * (height // size)))
    p = to_pixels(part).where((F.expr(f"(x div {size}) % 7") == 0) & (F.col("x") < size * (width // size)))
    p = p.where(keep) if keep is not None else p
    cells = p.groupBy("frame", F.expr(f"y div {size}").alias("cy"), F.expr(f"x div {size}").alias("cx")).agg(F.collect_list("v").alias("a"))

    @F.pandas_udf("n long, q double")
    def clipped(arrays: pd.Series) -> pd.DataFrame:
        out = []
        for a in arrays:
            v = np.sort(np.asarray(a, np.int64))
            for _ in range(rounds):
                median = v[len(v) // 2]
                top = int(median + 3.0 * np.sqrt(((v - median) ** 2).sum() / len(v)))
                keep_n = int(np.searchsorted(v, top, side="right"))
                if keep_n in (0, len(v)):
                    v = v[:keep_n]
                    break
                v = v[:keep_n]
            out.append((len(v), float((v * v).sum()) - float(v.sum()) ** 2 / len(v) if len(v) else 0.0))
        return pd.DataFrame(out, columns=["n", "q"])

    sums = cells.select("frame", clipped("a").alias("s"))
    return sums.groupBy("frame").agg(F.sqrt(F.sum("s.q") / F.sum("s.n")).alias("noise"))


def block_mean(pixels: DataFrame, k: int) -> DataFrame:
    """Means of k x k blocks, rounded half up; incomplete blocks are left out."""
    n = k * k
    return (
        pixels.groupBy("frame", F.expr(f"y div {k}").cast("int").alias("y"), F.expr(f"x div {k}").cast("int").alias("x"))
        .agg(F.sum("v").alias("s"), F.count("*").alias("n"))
        .where(F.col("n") == n)
        .select("frame", "y", "x", F.expr(f"cast((s + {n // 2}) div {n} as int)").alias("v"))
    )


def preview_levels(hist: DataFrame, keys: list[str], dark_level: float = 0.5, light_level: float = 0.5, light_max: int = MAX16) -> DataFrame:
    """(keys..., dark, light): between percentiles 1 and 60, and between 95 and the greatest value, by the two sliders."""
    ranks = {f"p{k}": percentile_rank(k, F.col("count")) for k in (1, 60, 95)}
    p = ranked(hist, keys, ranks)
    dark = F.col("p60") + (F.col("p1") - F.col("p60")) * F.lit(float(dark_level))
    light = F.lit(float(light_max)) + (F.col("p95") - F.lit(float(light_max))) * F.lit(float(light_level) ** 0.05)
    near = light - dark < 2.0
    return p.select(*keys, F.when(near, dark - 1).otherwise(dark).alias("dark"), F.when(near, light + 1).otherwise(light).alias("light"))


def tone(v: Column, dark: Column, light: Column, gamma: float = 2.2, gain: float | Column = 1.0) -> Column:
    """The 8-bit value of a pixel between two levels."""
    part = (v - dark) / (light - dark) * gain
    return F.when(part < 0, 0).when(part > 1, 255).otherwise(F.floor(F.pow(part, F.lit(1 / gamma)) * 255).cast("int")).cast("int")


def rgb_levels(hist: DataFrame, dark_level: float = 0.5, light_level: float = 0.5, light_max: int = MAX16) -> DataFrame:
    """(frame, chan, dark, light) of colour frames: green has its own levels, red and blue the same range, moved by how far their percentile 45 is from green's."""
    green = preview_levels(hist.where("chan = 'G'"), ["frame"], dark_level, light_level, light_max)
    mid = ranked(hist, ["frame", "chan"], {"mid": percentile_rank(45, F.col("count"))})
    of = mid.where("chan = 'G'").select("frame", F.col("mid").alias("green"))
    both = mid.join(green, "frame").join(of, "frame")
    moved = F.col("mid") - F.col("green")
    return both.select("frame", "chan", (F.col("dark") + moved).alias("dark"), (F.col("light") + moved).alias("light"))


def pixel_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """places (frame, y, x, ...) with the value v there; null outside of the frame."""
    inside = F.when(F.col("x") >= 0, F.get(F.col("row"), F.col("x").cast("int")))
    return places.join(rows.select("frame", "y", "row"), ["frame", "y"], "left").withColumn("v", inside).drop("row")


def channel_extremes(medians: DataFrame) -> DataFrame:
    """(frame, low, high): the least and the greatest of the medians (frame, median) of a frame's channels."""
    return medians.groupBy("frame").agg(F.min("median").alias("low"), F.max("median").alias("high"))


def monochrome(rows: DataFrame) -> DataFrame:
    """Raw row blocks as an image of one channel: the values as they are, their colours forgotten."""
    return rows.select("frame", F.lit("L").alias("chan"), "y", "row")


#: What parts the pieces of a mosaic (fixed value).
SPACING = 6


def corners_and_centre(rows: DataFrame, width: int, height: int, side: int) -> DataFrame:
    """(frame, y, x, v) of a square mosaic of nine pieces of a frame: its corners, the middles of its sides and its centre, in their true size."""
    piece = (side - 2 * SPACING) // 3
    places = lambda n: [0, (n - piece) // 2, n - piece]
    tops = [F.when(F.col("y").between(a, a + piece - 1), F.col("y") - a + b) for a, b in zip(places(height), places(side), strict=True)]
    lefts = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(b).alias("to")) for a, b in zip(places(width), places(side), strict=True)])
    r = rows.select("frame", "row", F.explode(F.array_compact(F.array(*tops))).alias("y")).select("frame", "y", "row", F.explode(lefts).alias("l"))
    return r.select("frame", "y", F.col("l.to").alias("left"), F.posexplode(F.slice("row", F.col("l.at") + 1, piece)).alias("k", "v")).select("frame", "y", (F.col("left") + F.col("k")).alias("x"), "v")
