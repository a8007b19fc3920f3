"""A watchdog over cameras: restarts one whose picture doesn't come after its exposure.

For each device a machine of five states, each but the first with a time limit. It moves on by changes of the exposure property,
or when its limit passes; a limit that lies before the next change's time counts first, so the result doesn't depend
on how the stream is cut into batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds in each state: without a picture, switched off, until the property is back, after that (fixed values).
LIMITS = {"wait_blob": 30_000, "shutdown": 2_000, "wait_property": 10_000, "after_restart": 5_000}
#: What a limit that passes leads to, and what is asked for then.
EXPIRED = {"wait_blob": ("shutdown", "switch_off"), "shutdown": ("wait_property", "switch_on"), "wait_property": ("waiting", "failed"), "after_restart": ("waiting", "restart_exposure")}
ACTIONS = "device string, at timestamp, action string, state string"


@dataclass
class Watch:
    state: str = "waiting"
    since: int = 0

    def deadline(self) -> int | None:
        return self.since + LIMITS[self.state] if self.state in LIMITS else None

    def until(self, now: int) -> Iterator[tuple[int, str, str]]:
        """(when, action, new state) for the limits that have passed."""
        while (at := self.deadline()) is not None and at <= now:
            self.state, action = EXPIRED[self.state]
            self.since = at
            yield at, action, self.state

    def change(self, now: int, new: bool, before: str | None, after: str | None, value: float | None) -> None:
        """The exposure property is there anew, or has changed: from state to state, to a value of seconds left."""
        if new:
            to = "after_restart" if self.state == "wait_property" else None
        else:
            zero = value == 0.0
            to = None
            if zero and after == "Busy" and self.state == "waiting":
                to = "wait_blob"
            elif self.state == "wait_blob" and (not zero or (before == "Busy" and after == "Ok")):
                to = "waiting"
        if to is not None:
            self.state, self.since = to, now


def _millis(ts: pd.Series) -> list[int]:
    return (pd.to_datetime(ts).astype("datetime64[ms]").astype("int64")).tolist()


def _text(v: object) -> str | None:
    return v if isinstance(v, str) else None


def _pass(watch: Watch, device: str, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for now, new, before, after, value in zip(_millis(rows["ts"]), rows["is_new"], rows["before"], rows["after"], rows["value"], strict=True):
        out += [_row(device, x) for x in watch.until(now)]
        watch.change(now, bool(new), _text(before), _text(after), None if value is None or value != value else float(value))
    return out


def _row(device: str, x: tuple[int, str, str]) -> tuple:
    return (device, dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=x[0]), *x[1:])


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ACTIONS.split(", ")])


class _Watchdog(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "state string, since long")

    def close(self) -> None:
        pass

    def _load(self) -> Watch:
        return Watch(*self.state.get()) if self.state.exists() else Watch()

    def _keep(self, watch: Watch, deadline: int | None) -> None:
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        if watch.state == "waiting":
            self.state.clear()
        else:
            self.state.update((watch.state, watch.since))
            self.handle.registerTimer(watch.deadline())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        watch = self._load()
        before = watch.deadline()
        out = _pass(watch, key[0], pd.concat(list(rows)).sort_values("ts", kind="stable"))
        self._keep(watch, before)
        if out:
            yield _table(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        watch = self._load()
        if watch.deadline() == expiredTimerInfo.getExpiryTimeInMs():
            out = [_row(key[0], x) for x in watch.until(watch.deadline())]
            self._keep(watch, None)
            yield _table(out)


def _changes(changes: DataFrame) -> DataFrame:
    return changes.selectExpr("device", "ts", "coalesce(is_new, false) is_new", "before", "after", "cast(value as double) value")


def exposure_watchdog(changes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """ACTIONS rows for a stream of changes of exposure properties (device, ts, is_new, before, after, value).

    is_new: the property has come up; else it changed from state `before` to `after`, with `value` seconds left. Time is that of
    the changes: a limit passes when a later change of the device says so, or when the watermark, `late` behind the latest change
    of all devices, does. A device that waits for nothing has no state.
    """
    d = _changes(changes).withWatermark("ts", late)
    return d.groupBy("device").transformWithStateInPandas(_Watchdog(), ACTIONS, "Append", "EventTime")


def watched(changes: DataFrame, until: dt.datetime) -> DataFrame:
    """What exposure_watchdog() gives for recorded changes, with the limits that pass up to `until`. One pass over a device's changes."""
    end = int((until - dt.datetime(1970, 1, 1)).total_seconds() * 1000)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        device, watch = rows["device"].iloc[0], Watch()
        out = _pass(watch, device, rows.sort_values("ts", kind="stable"))
        return _table(out + [_row(device, x) for x in watch.until(end)])

    return _changes(changes).groupBy("device").applyInPandas(one, ACTIONS)
