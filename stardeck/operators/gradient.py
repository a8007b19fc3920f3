"""Background gradients: a plane through the corners' levels, taken away in whole steps along each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import plane_fit
from .frames import saturate


def cell_places(width: int, height: int) -> list[tuple[int, int, int]]:
    """Centres and size of the cells in the four corners; none for frames under 510 pixels."""
    least = min(width, height)
    size = least // 30
    if size <= 16:
        return []
    border = size // 3
    n = max((least - 2 * border) // size // 4, 1)
    first = border + size // 2
    line = [(first + k * size, first) for k in range(n)] + [(first, first + k * size) for k in range(1, n - 1)]
    return [(x, y, size) for a, b in line for x, y in ((a, b), (width - a, b), (a, height - b), (width - a, height - b))]


def cells(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, x, y, z): the mean of the middle third of each corner cell's values.

    A pixel meets its cells by the 8-pixel tiles that those cover: an equi-join with a few hundred rows, fixed by the frame's size.
    """
    places = cell_places(width, height)
    spark = pixels.sparkSession
    tiles = [(ty, tx, x, y, s // 2) for x, y, s in places for ty in range((y - s // 2) // 8, (y + s // 2) // 8 + 1) for tx in range((x - s // 2) // 8, (x + s // 2) // 8 + 1)]
    t = spark.createDataFrame(tiles, "ty int, tx int, cx int, cy int, half int")
    p = pixels.withColumn("ty", F.expr("cast(y div 8 as int)")).withColumn("tx", F.expr("cast(x div 8 as int)")).join(F.broadcast(t), ["ty", "tx"])
    near = p.where((F.abs(F.col("x") - F.col("cx")) <= F.col("half")) & (F.abs(F.col("y") - F.col("cy")) <= F.col("half")))
    a = near.groupBy("frame", "cx", "cy").agg(F.sort_array(F.collect_list("v")).alias("a"))
    low, high = F.floor(F.size("a") / 3).cast("int"), F.floor(2 * F.size("a") / 3).cast("int")
    z = F.aggregate(F.slice("a", low + 1, high - low), F.lit(0.0), lambda s, v: s + v) / (high - low)
    return a.select("frame", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), z.alias("z"))


def plane(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, a, b, d) of the plane a x + b y + z + d = 0 through the cells' levels, less their mean."""
    c = cells(pixels, width, height)
    mean = c.groupBy("frame").agg(F.avg("z").alias("level"))
    c = c.join(mean, "frame").withColumn("z", F.col("z") - F.col("level"))
    a, b, d = plane_fit(F.col("x"), F.col("y"), F.col("z"))
    return c.groupBy("frame").agg(a.alias("a"), b.alias("b"), d.alias("d"))


def remove(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels less the gradient; unchanged where the plane's corners differ by under 5, or frames are small.

    Along a row the gradient goes from its rounded value at one end to that at the other in steps of one, where the
    line would step: pixel i has taken (width div 2 + i h) div width steps, h being the number of values in between.
    """
    if not cell_places(width, height):
        return pixels
    p = plane(pixels, width, height)
    at = lambda x, y: -(F.col("a") * x + F.col("b") * y + F.col("d"))
    corners = [at(F.lit(x), F.lit(y)) for x in (0, width) for y in (0, height)]
    flat = F.greatest(*corners) - F.least(*corners) < 5.0
    q = pixels.join(p.where(~flat), "frame", "left")
    z1, z2 = F.round(at(F.lit(0), F.col("y"))), F.round(at(F.lit(width), F.col("y")))
    q = q.withColumn("z1", z1.cast("int")).withColumn("z2", z2.cast("int"))
    h = F.abs(F.col("z1") - F.col("z2")) + 1
    step = F.floor((width // 2 + F.col("x") * h) / width).cast("int")
    ramp: Column = F.col("z1") + F.when(F.col("z1") < F.col("z2"), step).otherwise(-step)
    return q.select("frame", "y", "x", F.coalesce(saturate(F.col("v") - ramp), F.col("v")).alias("v"))
