"""A library of calibration masters that grows, and frames of many settings calibrated by it.

Masters are kept prepared: a dark with its mean and its hot pixels, a flat rid of the hot pixels of its time's dark and smoothed. That
is done once, when a master comes; it is then valid from its time on, for frames of its setting, until a later one of its kind is.
Frames meet their masters by id and row: what is shuffled are row blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import BY_BIAS, BY_DARK, BY_DEFECTS, BY_FLAT, flat_of, hot_in_dark, repair, smooth_flat
from .frames import saturate

#: kind: dark, bias or flat. mean: of a dark or bias. bad: its hot pixels in this row.
PREPARED = "master long, kind string, setting string, since long, offset int, y int, row array<int>, mean long, bad array<int>"


def as_of(frames: DataFrame, masters: DataFrame, kind: str, time: str = "time") -> DataFrame:
    """(frame, master): for each of frames (frame, setting, time) the latest master (master, kind, setting, since) of its setting that is valid by then.

    A row a frame and a row a master. Of two since the same time the greater id counts.
    """
    m = masters.where(F.col("kind") == kind).select("setting", "master", "since")
    met = frames.select("frame", "setting", F.col(time).alias("_t")).join(m, "setting").where(F.col("since") <= F.col("_t"))
    return met.groupBy("frame").agg(F.max(F.struct("since", "master"))["master"].alias("master"))


def heads(prepared: DataFrame) -> DataFrame:
    """(master, kind, setting, since, offset, mean): a row a master."""
    return prepared.groupBy("master", "kind", "setting", "since", "offset").agg(F.max("mean").alias("mean"))


def prepare(masters: DataFrame, width: int, height: int, cfa: str | None, known: DataFrame | None = None, defects: bool = True) -> DataFrame:
    """PREPARED rows of masters (master, kind, setting, since, offset, y, row). known: those that the library has, for the darks that flats look to."""
    m = masters.selectExpr("cast(master as long) master", "kind", "setting", "cast(since as long) since", "cast(offset as int) offset", "cast(y as int) y", "row")
    dark = m.where("kind <> 'flat'")
    total = F.aggregate("row", F.lit(0).cast("long"), lambda s, v: s + v)
    means = dark.select("master", total.alias("s"), F.size("row").alias("n")).groupBy("master").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).selectExpr("master", "s div n AS mean")
    hot = hot_in_dark(dark.where("kind = 'dark'").select(F.col("master").alias("frame"), "y", "row"), width, height)
    hot = hot.groupBy(F.col("frame").alias("master"), "y").agg(F.sort_array(F.collect_list("x")).alias("bad"))
    if not defects:
        hot = hot.limit(0)
    darks = dark.join(means, "master").join(hot, ["master", "y"], "left")
    darks = darks.select("master", "kind", "setting", "since", "offset", "y", "row", "mean", "bad")
    flat = m.where("kind = 'flat'")
    every = darks if known is None else darks.unionByName(known.where("kind <> 'flat'"))
    frames = flat.select(F.col("master").alias("frame"), "setting", "since").distinct()
    of = as_of(frames, heads(every), "dark", "since").select("frame", F.col("master").alias("dark"))
    rows = flat.select(F.col("master").alias("frame"), "y", "row").join(of, "frame", "left")
    bad = every.where("kind = 'dark' AND bad IS NOT NULL").select(F.col("master").alias("dark"), "y", F.explode("bad").alias("x"))
    smooth = smooth_flat(repair(rows, bad, cfa), cfa).select(F.col("frame").alias("master"), "y", "row")
    flats = flat.drop("row").join(smooth, ["master", "y"]).select("master", "kind", "setting", "since", "offset", "y", "row", F.lit(None).cast("long").alias("mean"), F.lit(None).cast("array<int>").alias("bad"))
    return darks.unionByName(flats)


def calibrate_by(rows: DataFrame, frames: DataFrame, prepared: DataFrame, cfa: str | None) -> DataFrame:
    """(frame, y, row, done): row blocks (frame, y, row) of frames (frame, setting, time, offset) calibrated by the masters valid at their time.

    A dark, or without one a bias, is subtracted; a flat divides; the dark's hot pixels are repaired. What a frame has no master for is
    left out; done has the bits of what was done.
    """
    h = heads(prepared)
    of = {k: as_of(frames, h, k).select("frame", F.col("master").alias(k)) for k in ("dark", "bias", "flat")}
    f = frames.select("frame", F.col("offset").cast("int").alias("offset"))
    for k in of:
        f = f.join(of[k], "frame", "left")
    f = f.withColumn("under", F.coalesce("dark", "bias"))
    level = h.where("kind <> 'flat'").select(F.col("master").alias("under"), F.col("mean").alias("under_mean"))
    f = f.join(level, "under", "left").join(h.where("kind = 'flat'").select(F.col("master").alias("flat"), F.col("offset").alias("flat_offset")), "flat", "left")
    done = F.when(F.col("dark").isNotNull(), BY_DARK + BY_DEFECTS).when(F.col("bias").isNotNull(), BY_BIAS).otherwise(0) + F.when(F.col("flat").isNotNull(), BY_FLAT).otherwise(0)
    f = f.withColumn("done", done.cast("int"))
    total = F.aggregate("row", F.lit(0).cast("long"), lambda s, v: s + v)
    mean = rows.select("frame", total.alias("s"), F.size("row").alias("n")).groupBy("frame").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).selectExpr("frame", "s div n AS mean")
    f = f.join(mean, "frame").withColumn("shift", F.coalesce(F.col("mean") - F.col("under_mean"), F.lit(0)).cast("int"))
    r = rows.select("frame", "y", "row").join(f.select("frame", "under", "dark", "flat", "offset", "flat_offset", "shift", "done"), "frame")
    one = lambda k, name: prepared.where("kind = 'flat'" if k == "flat" else "kind <> 'flat'").select(F.col("master").alias(k), "y", F.col("row").alias(name))
    r = r.join(one("under", "u"), ["under", "y"], "left").join(one("flat", "f"), ["flat", "y"], "left")
    less = F.when(F.col("u").isNull(), F.col("row")).otherwise(F.zip_with("row", "u", lambda v, d: saturate(v - d + F.col("shift"))))
    zero = F.col("offset") + F.col("shift")
    r = r.withColumn("row", less)
    r = r.withColumn("row", F.when(F.col("f").isNull(), F.col("row")).otherwise(F.zip_with("row", "f", flat_of(zero, F.col("flat_offset")))))
    bad = prepared.where("kind = 'dark' AND bad IS NOT NULL").select(F.col("master").alias("dark"), "y", F.explode("bad").alias("x"))
    fixed = repair(r.select("frame", "y", "row", "dark"), bad, cfa)
    return fixed.join(f.select("frame", "done"), "frame")


class Library:
    """Prepared masters in a folder that all machines share, a version of it for each addition."""

    def __init__(self, spark: SparkSession, folder: str, width: int, height: int, cfa: str | None):
        self.spark, self.folder, self.width, self.height, self.cfa = spark, folder, width, height, cfa
        self.version = 0

    def read(self) -> DataFrame:
        """All masters so far; those of a version that was not written to its end are none."""
        if not self.version:
            return self.spark.createDataFrame([], PREPARED)
        return self.spark.read.schema(PREPARED).parquet(*[f"{self.folder}/version={k}" for k in range(1, self.version + 1)])

    def add(self, masters: DataFrame) -> None:
        prepare(masters, self.width, self.height, self.cfa, self.read()).write.mode("overwrite").parquet(f"{self.folder}/version={self.version + 1}")
        self.version += 1

    def calibrating(self, target: str):
        """For foreachBatch over row blocks (frame, y, row, setting, time, offset): each batch by the masters that are there when it comes."""

        def write(batch: DataFrame, number: int) -> None:
            frames = batch.select("frame", "setting", "time", "offset").distinct()
            calibrate_by(batch.select("frame", "y", "row"), frames, self.read(), self.cfa).write.mode("overwrite").parquet(f"{target}/batch={number}")

        return write
