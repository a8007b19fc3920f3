"""Stacks that grow as frames come, row block by row block.

State is kept for each (session, channel, y): the sums of its row and, where tracks are to be removed, a ring of the last five
row blocks with their backgrounds. A new frame costs each row one slot of the ring and its sums, whatever the stack has seen;
rows of different y never meet, so a stack spreads over as many tasks as it has rows. Structured Streaming versions the state
by batch, so a batch that runs again starts from the same state and gives the same; a frame that was seen before is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.frames import MAX16

SLOTS = 5
STACKED = "session long, channel string, y int, frame long, frames long, v array<int>, cnt array<int>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, as state of several variables needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def half(s: np.ndarray) -> np.ndarray:
    """Halves, cut toward zero."""
    return np.sign(s) * (np.abs(s) // 2)


def middle_of(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The middle of up to five values in each column of (five, width): the mean of two, cut toward zero, where they are even, 0 of none."""
    s = np.sort(np.where(there, values, np.iinfo(np.int64).max), axis=0)
    n = there.sum(axis=0)
    upper = np.take_along_axis(s, np.minimum(n // 2, SLOTS - 1)[None], 0)[0]
    lower = np.take_along_axis(s, np.maximum(n // 2 - 1, 0)[None], 0)[0]
    return np.where(n == 0, 0, np.where(n % 2 == 1, upper, half(np.where(n % 2 == 0, lower + np.where(n > 0, upper, 0), 0))))


def _block(row: object) -> tuple[np.ndarray, np.ndarray]:
    """(values, where the frame covers the row): nulls come as None or as not-a-number."""
    a = np.array(row, dtype=np.float64) if row is not None else np.zeros(0)
    there = ~np.isnan(a)
    return np.where(there, a, 0).astype(np.int64), there


class _Sums(StatefulProcessor):
    """Sums and counts of what covers each pixel."""

    def __init__(self, each: bool):
        self.each = each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "last long, frames long, total binary, counts binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(rows)).sort_values("frame", kind="stable")
        last, frames, total, counts = self.start()
        out = []
        for frame, background, row in zip(block["frame"], block["background"], block["row"], strict=True):
            if last is not None and frame <= last:
                continue
            values, there = _block(row)
            if total is None:
                total, counts = np.zeros(len(values), np.int64), np.zeros(len(values), np.int32)
            self.add(frames, int(frame), int(background), values, there, total, counts)
            last, frames = int(frame), frames + 1
            if self.each or not out:
                out.append(None)
            out[-1] = (*key, last, frames, *self.seen(frames, total, counts))
        if out:
            self.sums.update((last, frames, total.tobytes(), counts.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STACKED.split(", ")])

    def start(self) -> tuple:
        if not self.sums.exists():
            return None, 0, None, None
        last, frames, total, counts = self.sums.get()
        return last, frames, np.frombuffer(total, np.int64).copy(), np.frombuffer(counts, np.int32).copy()

    def add(self, before: int, frame: int, background: int, values: np.ndarray, there: np.ndarray, total: np.ndarray, counts: np.ndarray) -> None:
        total += values
        counts += there

    def seen(self, frames: int, total: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
        return np.clip(total // np.maximum(counts, 1), 0, MAX16).tolist(), counts.tolist()


class _Medians(_Sums):
    """From the fifth frame on, sums of the medians of five; before that, the mean of what the ring holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getMapState("ring", "slot int", "background long, row binary")

    def held(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = [self.ring.getValue((k,)) for k in range(n)]
        return np.array([f[0] for f in found], np.int64), np.stack([np.frombuffer(f[1], np.uint16) for f in found]).astype(np.int64)

    def add(self, before: int, frame: int, background: int, values: np.ndarray, there: np.ndarray, total: np.ndarray, counts: np.ndarray) -> None:
        # 0 in the ring is a place that the frame doesn't cover, so a covered pixel is 1 at least
        row = np.where(there, np.clip(values, 1, MAX16), 0).astype(np.uint16)
        self.ring.updateValue((before % SLOTS,), (background, row.tobytes()))
        if before + 1 >= SLOTS:
            backgrounds, five = self.held(SLOTS)
            common = int(np.sort(backgrounds)[SLOTS // 2])
            total += np.maximum(middle_of(five - backgrounds[:, None], five != 0) + common, 0)
            counts += 1

    def seen(self, frames: int, total: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
        if frames >= SLOTS:
            return super().seen(frames, total, counts)
        _, rows = self.held(frames)
        n = (rows != 0).sum(axis=0)
        return (rows.sum(axis=0) // np.maximum(n, 1)).tolist(), [0] * len(n)


def live_stack(blocks: DataFrame, tracks: bool = True, each: bool = False) -> DataFrame:
    """The growing stack of a stream of row blocks (session, channel, y, frame, background, row), as STACKED rows.

    Blocks are of warped frames, null where a frame covers nothing. With `tracks` they stay in the mean, without them each frame
    from the fifth on adds the median of the last five, each less its background and plus the middle one of the five, so what
    crosses a single frame is not in the sum. A batch gives each of its rows once, as it is after its last frame, or with
    `each` after every frame. v is the mean, cut to whole numbers and to 16 bits, cnt how many values are in it: 0 for the means of the
    first four frames of medians. Frames of a row are taken by number; one that is not greater than the last that was taken
    is left out. State is one row of sums and at most five row blocks for each key.
    """
    states = blocks.selectExpr("cast(session as long) session", "channel", "cast(y as int) y", "cast(frame as long) frame", "coalesce(cast(background as long), 0) background", "cast(row as array<int>) row").where("frame IS NOT NULL")
    machine = _Sums(each) if tracks else _Medians(each)
    return states.groupBy("session", "channel", "y").transformWithStateInPandas(machine, STACKED, "Update", "None")


def land(path: str, warped):
    """For foreachBatch: writes warped(batch), row blocks of the batch's whole frames, to a folder of its own number under path.

    A batch that runs again writes the same folder. landed() is the stream of such folders: the frames of a batch are turned by
    batch operators, as a row of the result needs rows of its source, and then stacked row by row.
    """

    def write(batch: DataFrame, number: int) -> None:
        warped(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


BLOCKS = "session long, channel string, y int, frame long, background long, row array<int>"


def landed(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The stream of row blocks that land() writes."""
    return spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/batch=*")


def latest(stacked: DataFrame) -> DataFrame:
    """The last of STACKED rows for each (session, channel, y), for a stream that was appended to a table."""
    from pyspark.sql import functions as F

    rest = [c for c in stacked.columns if c not in ("session", "channel", "y", "frames")]
    last = stacked.groupBy("session", "channel", "y").agg(F.max_by(F.struct(*rest), "frames").alias("s"), F.max("frames").alias("frames"))
    return last.select("session", "channel", "y", "s.frame", "frames", "s.v", "s.cnt")
