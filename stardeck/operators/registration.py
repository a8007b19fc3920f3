"""Registration of star lists: triangles, their matching, and the offset and angle between two frames.

Triangles are made of a frame's brightest stars only, a number fixed by the caller, so their count is bounded
however many stars or frames there are. Matching looks up cells of perimeter and sides in the reference's triangles, which every
task has, with the exact test after it; nothing compares all triangles with all, and no triangle is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import wrap
from .cuts import cut

#: Attempts: stars taken and greatest error (fixed values).
ATTEMPTS = ((50, 2.5), (70, 1.5), (100, 1.5))
LEAST_TRIANGLES, ROUNDS, ANGLE_ERROR = 10, 10, math.radians(1.5)


def brightest(stars: DataFrame, n: int) -> DataFrame:
    """(frame, i, x, y): the n brightest stars of each frame, numbered."""
    # few bytes make many triangles, so partitions are not to be merged by their size
    stars = stars.repartition(int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame")
    order = Window.partitionBy("frame").orderBy(F.desc("brightness"), "x", "y")
    return stars.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n).select("frame", "i", "x", "y")


def triangles(points: DataFrame, least: float) -> DataFrame:
    """(frame, i, j, k, a, b, c, len, p ARRAY) of any three points once: sides from the shortest on, corners i, j, k turned alike.

    Made within a frame's bounded array of points, so that no join is needed.
    """
    p = points.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("s"))
    p = p.select("frame", "s", F.posexplode("s").alias("n", "p1"))
    p = p.select("frame", "s", "p1", F.posexplode(F.slice("s", F.col("n") + 2, F.size("s"))).alias("m", "p2"), "n")
    p = p.select("frame", "p1", "p2", F.explode(F.slice("s", F.col("n") + F.col("m") + 3, F.size("s"))).alias("p3"))
    d = lambda u, v: F.sqrt((F.col(f"{u}.x") - F.col(f"{v}.x")) ** 2 + (F.col(f"{u}.y") - F.col(f"{v}.y")) ** 2)
    t = p.withColumn("l1", d("p1", "p2")).withColumn("l2", d("p2", "p3")).withColumn("l3", d("p3", "p1")).withColumn("len", F.col("l1") + F.col("l2") + F.col("l3"))
    t = t.where(F.col("len") >= least)
    first = (F.col("l1") <= F.col("l2")) & (F.col("l1") <= F.col("l3"))
    second = F.col("l2") <= F.col("l3")
    pick = lambda *o: F.when(first, o[0]).when(second, o[1]).otherwise(o[2])
    sides = [F.when(first, F.col(x)).when(second, F.col(y)).otherwise(F.col(z)) for x, y, z in (("l1", "l2", "l3"), ("l2", "l3", "l1"), ("l3", "l1", "l2"))]
    corners = pick(F.array("p1", "p2", "p3"), F.array("p2", "p3", "p1"), F.array("p3", "p1", "p2"))
    t = t.withColumn("p", corners)
    return t.select("frame", *[F.col("p")[n]["i"].alias(c) for n, c in enumerate("ijk")], *[s.alias(n) for s, n in zip(sides, "abc", strict=True)], "len", "p")


def matches(reference: DataFrame, others: DataFrame, error: float) -> DataFrame:
    """Pairs of similar triangles: perimeters within the error and squared side differences under its square.

    reference: triangles of one frame, at most those of 100 points. The perimeter, the first and the second side lie in cells as
    wide as the error: as none of them differs by more, a triangle finds those of the reference in its own cell and the 26 around it.
    """
    names = ("len", "a", "b")
    cell = lambda c: F.floor(F.col(c) / error).cast("long")
    # one number for three cells; those far apart may share one, as the exact test follows, but none of the 27 does
    key = lambda parts: sum((F.pmod(p, F.lit(1 << 20)) * F.lit(k) for p, k in zip(parts, (1 << 40, 1 << 20, 1), strict=True)), F.lit(0).cast("long"))
    r = reference.select(*[F.col(c).alias(f"r{c}") for c in ("i", "j", "k", "a", "b", "c", "len", "p")], key([cell(c) for c in names]).alias("_cell"))
    o = others
    for c in names:
        o = o.select("*", F.explode(F.sequence(cell(c) - 1, cell(c) + 1)).alias(f"_{c}"))
    o = o.withColumn("_cell", key([F.col(f"_{c}") for c in names])).drop(*[f"_{c}" for c in names])
    both = o.join(F.broadcast(r), "_cell").where((F.col("len") >= F.col("rlen") - error) & (F.col("len") < F.col("rlen") + error))
    diff = sum(((F.col(x) - F.col(f"r{x}")) ** 2 for x in "abc"), F.lit(0.0))
    return both.where(diff < error * error).drop("_cell")


def turn_between(mine: str = "rp", other: str = "p") -> Column:
    """The mean turn of a triangle's three edges from the reference to the other."""
    angles = []
    for u, v in ((0, 1), (1, 2), (2, 0)):
        edge = lambda p: F.atan2(F.col(p)[v]["y"] - F.col(p)[u]["y"], F.col(p)[v]["x"] - F.col(p)[u]["x"])  # noqa: B023, E731
        angles.append(wrap(edge(other) - edge(mine)))
    return F.atan2(sum((F.sin(a) for a in angles), F.lit(0.0)), sum((F.cos(a) for a in angles), F.lit(0.0)))


def offsets(reference: DataFrame, stars: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, x, y, angle) of each frame against the reference's stars; null without enough agreement.

    Matching is by Spark; the rounds of rejection run over one frame's matched triangles in one task, whose
    number is bounded by that of the brightest stars. Frames without an answer are tried anew with more stars.
    """
    # at most 100 points a frame; they are used by every attempt
    most = ATTEMPTS[-1][0]
    few = lambda d: cut(brightest(d, most).select("frame", "x", "y", (-F.col("i")).alias("brightness")))
    reference, points = few(reference), few(stars)
    todo = points.select("frame").distinct()
    out = None
    for n, error in ATTEMPTS:
        least = (width + height) / 10
        r = triangles(brightest(reference, n), least)
        o = triangles(brightest(points.join(todo, "frame", "left_semi"), n), least)
        m = matches(r, o, error).select("frame", turn_between().alias("angle"), *[(sum((F.col(p)[k][c] for k in range(3)), F.lit(0.0)) / 3).alias(f"{p}{c}") for p in ("p", "rp") for c in "xy"])
        found = m.groupBy("frame").applyInPandas(_agree(width, height, error), "frame long, x double, y double, angle double").where("x IS NOT NULL")
        out = found if out is None else out.unionByName(found)
        todo = todo.join(found.select("frame"), "frame", "left_anti")
    return points.select("frame").distinct().join(out, "frame", "left")


def _mean_angle(a: np.ndarray) -> float:
    return math.atan2(np.sin(a).sum(), np.cos(a).sum())


def _agree(width: int, height: int, error: float):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        frame = int(rows["frame"].iloc[0])
        nothing = pd.DataFrame({"frame": [frame], "x": [None], "y": [None], "angle": [None]}).astype({"x": "float64", "y": "float64", "angle": "float64"})
        t = rows.sort_values(["px", "py", "rpx", "rpy"])
        cx, cy = (width - 1) / 2, (height - 1) / 2
        for _ in range(ROUNDS):
            before = len(t)
            if before < LEAST_TRIANGLES:
                return nothing
            turned = np.degrees(t["angle"])
            degrees = (np.sign(turned) * np.floor(np.abs(turned) + 0.5)).astype(int)  # halves go away from zero
            degrees = degrees.where(degrees > -180, degrees + 360)
            counts = degrees.value_counts()
            mode = math.radians(int(counts[counts == counts.max()].index.min()))
            gap = (t["angle"] - mode + math.pi) % (2 * math.pi) - math.pi
            t = t[gap.abs() < ANGLE_ERROR]
            angle = _mean_angle(t["angle"].to_numpy())
            dx, dy = t["px"] - cx, t["py"] - cy
            c, s = math.cos(-angle), math.sin(-angle)
            t = t.assign(x=cx + dx * c - dy * s - t["rpx"], y=cy + dy * c + dx * s - t["rpy"])
            mx, my = (np.sort(t[k].to_numpy())[len(t) // 2] for k in "xy")
            t = t[((t["x"] - mx).abs() < error / 2) & ((t["y"] - my).abs() < error / 2)]
            if len(t) < LEAST_TRIANGLES:
                return nothing
            if len(t) == before:
                break
        return pd.DataFrame({"frame": [frame], "x": [t["x"].mean()], "y": [t["y"].mean()], "angle": [_mean_angle(t["angle"].to_numpy())]})

    return one
