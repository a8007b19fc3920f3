"""Streams of shots and of device changes, with the state that the batch forms keep.

The stateful operators are the same step functions as in operators.sessions, over Structured Streaming state
keyed by camera. Watermarks, windows and exactly-once sinks are additions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cuts import drop_folder
from ..operators.sessions import RefocusState, accumulate

SHOT = "camera long, shot long, ts timestamp, exposure double, temp double, fwhm double, ok boolean"


def read_shots(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Shots from a growing folder of Parquet files; files_per_batch bounds what a micro-batch takes on."""
    return spark.readStream.schema(SHOT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts", "shot"])


def dither(shots: DataFrame, period: float) -> DataFrame:
    """(camera, shot, dither) as sessions.dither, for shots that come in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(parts)
        fired, left = accumulate(rows["exposure"].to_numpy(), period, state.get[0] if state.exists else 0.0)
        state.update((float(left),))
        yield rows[["camera", "shot"]].assign(dither=fired)

    return shots.groupBy("camera").applyInPandasWithState(step, "camera long, shot long, dither boolean", "total double", "append", GroupStateTimeout.NoTimeout)


def refocus(shots: DataFrame, period: float, temp_change: float, percent: int) -> DataFrame:
    """(camera, shot, refocus) as sessions.refocus, for shots that come in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(parts)
        s = RefocusState()
        if state.exists:
            total, first, low, high, seen = state.get
            s = RefocusState(total, first, low, high, seen)
        out = [s.add(e, None if t != t else t, f, ok, period, temp_change, percent) for e, t, f, ok in zip(rows["exposure"], rows["temp"], rows["fwhm"], rows["ok"], strict=True)]
        state.update((float(s.total), None if s.first is None else float(s.first), float(s.low), float(s.high), int(s.seen)))
        yield rows[["camera", "shot"]].assign(refocus=out)

    kept = "total double, first double, low double, high double, seen long"
    return shots.groupBy("camera").applyInPandasWithState(step, "camera long, shot long, refocus boolean", kept, "append", GroupStateTimeout.NoTimeout)


def first_good(shots: DataFrame) -> DataFrame:
    """(camera, shot): the first shot of each camera that is ok, given once; later frames are registered against it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(parts)
        good = rows[rows["ok"].astype(bool)]
        if not state.exists and len(good):
            state.update((int(good["shot"].iloc[0]),))
            yield good[["camera", "shot"]].head(1)

    return shots.groupBy("camera").applyInPandasWithState(step, "camera long, shot long", "shot long", "append", GroupStateTimeout.NoTimeout)


def watchdog(shots: DataFrame, seconds: int) -> DataFrame:
    """(camera, silent_since): cameras without a shot for `seconds` of processing time, given once until they shoot again."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"camera": [key[0]], "silent_since": [pd.Timestamp(since)]})
            return
        rows = _ordered(parts)
        state.update((rows["ts"].max().isoformat(),))
        state.setTimeoutDuration(seconds * 1000)

    return shots.groupBy("camera").applyInPandasWithState(step, "camera long, silent_since timestamp", "last string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def exposure_windows(shots: DataFrame, length: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Exposure and good shots for each camera and tumbling window; shots later than `late` are dropped by the watermark."""
    w = shots.withWatermark("ts", late).groupBy(F.window("ts", length), "camera")
    return w.agg(F.sum("exposure").alias("exposure"), F.sum(F.col("ok").cast("long")).alias("good")).select("camera", F.col("window.start").alias("start"), "exposure", "good")


def upsert_properties(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the last change of each (device, prop, elem) in numbered folders under path.

    Batch n reads folder n - 1 and writes folder n, so a batch that runs again writes the same; older folders are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = ["change_id", "change", "value"]
        new = batch.select("device", "prop", "elem", *names)
        if number:
            new = new.unionByName(spark.read.schema(new.schema).parquet(f"{path}/{number - 1}"))
        last = new.groupBy("device", "prop", "elem").agg(F.max(F.struct(*names)).alias("c")).select("device", "prop", "elem", "c.*")
        last.write.mode("overwrite").parquet(f"{path}/{number}")
        drop_folder(spark, f"{path}/{number - 2}")

    return write


#: What a guider's events make of its state (names as the protocol has them; fixed values).
GUIDER_STATES = {
    "GuideStep": "Guiding", "Paused": "Paused", "StartCalibration": "Calibrating", "LoopingExposures": "Looping", "LoopingExposuresStopped": "Stopped",
}
GUIDER_EVENT = "Event string, Timestamp double, Host string, Inst int, State string, Status int, Error string, dx double, dy double, id long"


def guider_events(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed lines of a guider's protocol, with the columns `keep`: an event, or the answer to a call; what is neither is left out."""
    e = F.from_json(F.col(column), GUIDER_EVENT)
    failed = F.get_json_object(column, "$.error.message")
    d = lines.select(e.alias("e"), failed.alias("failed"), "*").where("e.Event IS NOT NULL OR e.id IS NOT NULL")
    state = F.when(F.col("e.Event") == "AppState", F.col("e.State"))
    for event, name in GUIDER_STATES.items():
        state = state.when(F.col("e.Event") == event, name)
    done = F.when((F.col("e.Event") == "SettleDone") & (F.col("e.Status") == 0), "DitheringFinished").when(F.col("e.Event") == "SettleDone", "DitheringFailed")
    return d.select(*keep, F.col("e.Timestamp").alias("timestamp"), F.col("e.Event").alias("event"), state.alias("state"), F.coalesce(done, F.when(F.col("failed").isNotNull(), "Error")).alias("outcome"), F.coalesce("e.Error", "failed").alias("message"))


def guide_correction(distance: Column, dx: Column, dy: Column, limit: float) -> tuple[Column, Column]:
    """The move that answers a guiding error: none within the limit, half of it under twice the limit."""
    k = F.when(distance <= limit, 0.0).when(distance < 2 * limit, 0.5).otherwise(1.0)
    return dx * k, dy * k
