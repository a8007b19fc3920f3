"""Observing sessions: accumulators with resets, triggers, calibrations and fits over ordered shots.

Each function works on shots of many cameras at once. Running sums and state that resets are passed in spans of a camera's
shots, side by side, so one camera may have most of the shots; the streaming twins keep the same state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import line_fit, square_fit
from .cuts import cut
from .spans import SPAN, dealt, numbered, place_of, running


def with_running_exposure(shots: DataFrame, span: int = SPAN) -> DataFrame:
    """shots with `total`, the exposure so far, and `ok_count`, the good shots so far, by (ts, shot) in each camera; nulls come first."""
    return running(shots, "ts", ("shot",), "camera", {"total": F.col("exposure"), "ok_count": F.col("ok").cast("long")}, span)


def accumulate(exposures: np.ndarray, period: float, start: float = 0.0) -> tuple[np.ndarray, float]:
    """Where a sum of exposures reaches the period (and starts anew), and what is left of it."""
    fired, total = np.zeros(len(exposures), bool), start
    for i, e in enumerate(exposures):
        total += e
        if total >= period:
            fired[i], total = True, 0.0
    return fired, total


# --- state that resets, span by span ----------------------------------------------------------------------------------


def _in_spans(shots: DataFrame, columns: dict[str, Column], span: int) -> DataFrame:
    """(camera, shot, _span, _o, columns), written: spans of a camera's shots by time, those without one last."""
    last = F.coalesce(place_of(shots, "ts"), F.lit(math.inf))
    rows = shots.select(F.col("camera").cast("long").alias("camera"), F.col("shot").cast("long").alias("shot"), last.alias("_o"), *[c.alias(name) for name, c in columns.items()])
    return cut(dealt(rows, "_o", "camera", span).drop("_key"))


def _dealt_out(rows: DataFrame) -> DataFrame:
    return rows.repartition("camera", "_span").sortWithinPartitions("camera", "_span", "_o", F.col("shot").asc_nulls_last())


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """((camera, span), whether it begins here, rows) for the runs of each batch; a span may go on in the next one."""
    last: tuple | None = None
    for batch in batches:
        keys, at = list(zip(batch.column("camera").to_pylist(), batch.column("_span").to_pylist(), strict=True)), 0
        for key, run in groupby(keys):
            n = sum(1 for _ in run)
            yield key, key != last, batch.slice(at, n).select(names)
            last, at = key, at + n


def carry_of(exposures: np.ndarray, period: float) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of shots makes of the sum that enters it: (lead, carries).

    Entering with some sum, it resets at a shot of the lead at the latest, and all behind that depends on this shot alone: carries are the
    sums that the stretch ends with, one for each shot of the lead. Where the lead is all of the stretch there are no carries.
    Sums are those of accumulate(), rounding and all: where the running sum of the stretch leaves a reset open, it is added up anew.
    """
    n, so_far = len(exposures), np.cumsum(exposures)
    slack = 4 * n * np.finfo(float).eps * (so_far[-1] + abs(period))  # more than rounding may move a sum
    lead = int(np.searchsorted(so_far, period + slack)) + 1
    if lead >= n:
        return exposures, np.empty(0)
    # the next reset after one at shot i, or the length if there is none, lies within these
    after = np.arange(1, n + 1)
    then, latest = (np.maximum(np.searchsorted(so_far, so_far + (period + s)), after) for s in (-slack, slack))
    met = np.arange(n) < lead
    for i in range(n):
        if not met[i]:
            continue
        if then[i] < latest[i]:
            then[i] = i + 1 + np.searchsorted(np.cumsum(exposures[i + 1 : latest[i] + 1]), period)
        if then[i] < n:
            met[then[i]] = True
    left = np.zeros(n)
    for i in np.nonzero(met)[0][::-1]:
        left[i] = left[then[i]] if then[i] < n else np.cumsum(np.append(0.0, exposures[i + 1 :]))[-1]
    return exposures[:lead], left[:lead]


def carried(total: float, lead: np.ndarray, carries: np.ndarray, period: float) -> float:
    """What a sum that enters a stretch leaves it with, by carry_of()."""
    while True:
        sums = np.cumsum(np.append(total, lead))
        at = int(np.searchsorted(sums[1:], period))
        if at == len(lead):
            return float(sums[-1])
        if len(carries):
            return float(carries[at])
        total, lead = 0.0, lead[at + 1 :]


def dither(shots: DataFrame, period: float, span: int = SPAN, unit: float | None = 1e-6) -> DataFrame:
    """(camera, shot, dither): a move after each time the summed exposure, in whole units (microseconds), reaches the period.

    Without a unit, exposures are added as the doubles that they are, one after the other, as SQL and the streaming twin add them.
    A camera's shots are taken by (ts, shot), those without a time last; a null or negative exposure is 0. Spans of about `span`
    shots first say, side by side, what they make of the sum that enters them; a row a span is then followed through each camera,
    and the spans are passed once more from where they start. A camera with most of the shots is spread over as many tasks as it has spans.
    """
    counted = lambda c: c if unit is None else F.round(c * round(1 / unit))
    whole = float(period if unit is None else round(period * round(1 / unit)))
    exposure = F.greatest(F.coalesce(counted(F.nanvl(F.col("exposure").cast("double"), F.lit(0.0))), F.lit(0.0)), F.lit(0.0))
    # more than the period is no more than the period
    rows = _in_spans(shots, {"e": F.least(exposure, F.lit(max(whole, 0.0)))}, span)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def done() -> pa.RecordBatch:
            lead, carries = carry_of(np.concatenate(held), whole)
            return pa.RecordBatch.from_pylist([{"camera": now[0], "_span": now[1], "lead": lead, "carries": carries}], schema=functions_schema)

        for key, begins, part in _groups(batches, ["e"]):
            if begins and now is not None:
                yield done()
                held = []
            now = key
            held.append(part.column(0).to_numpy())
        if now is not None:
            yield done()

    functions_schema = pa.schema([("camera", pa.int64()), ("_span", pa.int32()), ("lead", pa.list_(pa.float64())), ("carries", pa.list_(pa.float64()))])
    of_spans = _dealt_out(rows).mapInArrow(functions, "camera long, _span int, lead array<double>, carries array<double>")

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, total = object(), 0.0
        for batch in batches:
            into = []
            for c, lead, carries in zip(*[batch.column(k) for k in ("camera", "lead", "carries")], strict=True):
                if c.as_py() != camera:
                    camera, total = c.as_py(), 0.0
                into.append(total)
                total = carried(total, lead.values.to_numpy(), carries.values.to_numpy(), whole)
            yield pa.RecordBatch.from_arrays([batch.column("camera"), batch.column("_span"), pa.array(into, pa.float64())], ["camera", "_span", "enters"])

    entries = of_spans.repartition("camera").sortWithinPartitions("camera", "_span").mapInArrow(followed, "camera long, _span int, enters double")
    return _passed(rows, entries, ["enters"], ["e"], "dither", lambda enters: enters[0], lambda values, total: accumulate(values[0], whole, total))


def _with_entries(rows: DataFrame, entries: DataFrame, states: list[str]) -> DataFrame:
    e = entries.select(F.col("camera").alias("_ec"), F.col("_span").alias("_es"), *states)
    return _dealt_out(rows.join(e, F.col("camera").eqNullSafe(F.col("_ec")) & (F.col("_span") == F.col("_es"))).drop("_ec", "_es"))


def _passed(rows: DataFrame, entries: DataFrame, states: list[str], columns: list[str], name: str, start: Callable, step: Callable) -> DataFrame:
    """(camera, shot, name): step(columns of some shots in order, state) gives a flag a shot and the state for the next ones, from entries (camera, _span, states) on."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for (camera, _), begins, part in _groups(batches, ["shot", *columns, *states]):
            if begins:
                state = start([part.column(c)[0].as_py() for c in states])
            flags, state = step([part.column(c).to_numpy(zero_copy_only=False) for c in columns], state)
            yield pa.RecordBatch.from_arrays([pa.array([camera] * part.num_rows, pa.int64()), part.column("shot"), pa.array(np.asarray(flags, bool))], ["camera", "shot", name])

    return _with_entries(rows, entries, states).mapInArrow(make, f"camera long, shot long, {name} boolean")


REFOCUS_STATE = ["total", "first", "low", "high", "seen"]
_NUMBERS = ", ".join(f"{c} double" for c in REFOCUS_STATE)


def refocus(shots: DataFrame, period: float, temp_change: float, fwhm_percent: int, span: int = SPAN) -> DataFrame:
    """(camera, shot, refocus): by summed exposure, by change of temperature, or by growth of FWHM since the last time.

    shots: camera, shot, ts, exposure, temp, fwhm, ok, taken by (ts, shot), those without a time last. A refocus resets all three;
    temperatures that are null say nothing. Spans of about `span` shots are passed side by side, at first from nothing. As a refocus
    forgets, they mostly end as they should even so: each is passed again from the end of the one before, until every span starts with
    what the one before it ends with. Each round settles at least one more span of each camera, so the result is exact.
    """
    columns = {**{c: F.col(c).cast("double") for c in ("exposure", "temp", "fwhm")}, "ok": F.col("ok").cast("boolean")}
    rows, names = _in_spans(shots, columns, span), list(columns)

    def step(values: list[np.ndarray], state: RefocusState) -> tuple[list[bool], RefocusState]:
        return [state.add(e, t, f, ok, period, temp_change, fwhm_percent) for e, t, f, ok in zip(*values, strict=True)], state

    def start(s: list[float | None]) -> RefocusState:
        return RefocusState(s[0], s[1], s[2], s[3], int(s[4]))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for key, begins, part in _groups(batches, [*names, *REFOCUS_STATE]):
            if begins:
                if now is not None:
                    out.append((*now, *state.numbers()))
                now, state = key, start([part.column(c)[0].as_py() for c in REFOCUS_STATE])
            _, state = step([part.column(c).to_numpy(zero_copy_only=False) for c in names], state)
        if now is not None:
            out.append((*now, *state.numbers()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["camera", "_span", *REFOCUS_STATE]), schema=ends_schema, preserve_index=False)

    ends_schema = pa.schema([("camera", pa.int64()), ("_span", pa.int32()), *[(c, pa.float64()) for c in REFOCUS_STATE]])
    nothing = dict(zip(REFOCUS_STATE, RefocusState().numbers(), strict=True))
    fresh = [F.lit(v).cast("double").alias(c) for c, v in nothing.items()]
    entries = cut(rows.select("camera", "_span").distinct().select("*", *fresh))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    order = Window.partitionBy("camera").orderBy("_span")
    found, wrong = None, entries
    while True:
        ended = _with_entries(rows, wrong, REFOCUS_STATE).mapInArrow(ends, f"camera long, _span int, {_NUMBERS}")
        end = F.struct(*REFOCUS_STATE)
        ended = ended.select("camera", "_span", end.alias("end"))
        if found is not None:  # the ends of spans that were right stand
            kept = found.where("NOT wrong").select("camera", "_span", "end")
            ended = ended.unionByName(kept)
        met = entries.select(F.col("camera").alias("_ec"), F.col("_span").alias("_es"), F.struct(*REFOCUS_STATE).alias("start"))
        d = ended.join(met, same("camera", "_ec") & (F.col("_span") == F.col("_es"))).drop("_ec", "_es")
        d = d.withColumn("due", F.coalesce(F.lag("end").over(order), F.struct(*fresh)))
        found = cut(d.withColumn("wrong", ~F.col("due").eqNullSafe(F.col("start"))))
        if found.where("wrong").isEmpty():
            break
        entries = found.select("camera", "_span", "due.*")
        wrong = found.where("wrong").select("camera", "_span", "due.*")
    return _passed(rows, entries, REFOCUS_STATE, names, "refocus", start, step)


class RefocusState:
    """What the three triggers remember: a sum, a temperature and the least and greatest FWHM."""

    def __init__(self, total: float = 0.0, first: float | None = None, low: float = np.inf, high: float = -np.inf, seen: int = 0):
        self.total, self.first, self.low, self.high, self.seen = total, first, low, high, seen

    def numbers(self) -> tuple:
        return self.total, self.first, self.low, self.high, float(self.seen)

    def add(self, exposure: float, temp: float | None, fwhm: float | None, ok: bool, period: float, temp_change: float, percent: int) -> bool:
        if fwhm is not None and fwhm == fwhm and ok:
            self.low, self.high, self.seen = min(self.low, fwhm), max(self.high, fwhm), self.seen + 1
        self.total += exposure
        known = temp is not None and np.isfinite(temp)
        if known and self.first is None:
            self.first = temp
        late = period > 0 and self.total >= period
        moved = temp_change > 0 and self.first is not None and known and abs(temp - self.first) >= temp_change
        grown = self.seen >= 2 and self.high > self.low and self.low != 0 and int(100 * (self.high - self.low) / self.low) > percent
        if not (late or moved or grown):
            return False
        self.__init__(first=temp if known else self.first)
        return True


def stable_temperature(ticks: DataFrame, target: Column, length: int = 80) -> DataFrame:
    """Adds `stable`: over the last `length` ticks the range is under 2 and the mean is within 1 of the target."""
    w = Window.partitionBy("camera").orderBy("ts", "tick").rowsBetween(1 - length, 0)
    full = F.count("temp").over(w) == length
    near = F.abs(F.avg("temp").over(w) - target) < 1
    return ticks.withColumn("stable", full & (F.max("temp").over(w) - F.min("temp").over(w) < 2) & near)


def axis_calibration(moves: DataFrame, span: int = SPAN) -> DataFrame:
    """(axis, moves, speed): the mean length of a mount's moves over the time, of those longer than half the longest.

    moves: axis, n, x, y (positions in order), seconds. On the axis "dec" the first move is left out. Axes are
    few, so their rows are taken in spans of about `span`.
    """
    before = F.col("_before")
    dist = F.hypot(F.col("x") - before["x"], F.col("y") - before["y"])
    d = numbered(moves, "n", "axis", ("x", "y"), span).withColumn("dist", dist).where("dist IS NOT NULL").where("axis <> 'dec' OR _k > 2")
    longest = d.groupBy(F.col("axis").alias("_axis")).agg(F.max("dist").alias("longest"))
    far = d.join(longest, F.col("axis").eqNullSafe(F.col("_axis"))).where("dist > 0.5 * longest")
    return far.groupBy("axis").agg(F.count("*").alias("moves"), (F.avg("dist") / F.avg("seconds")).alias("speed"))


def best_focus(samples: DataFrame) -> DataFrame:
    """(run, a0, a1, a2, extremum): a parabola through the least size at each focuser position."""
    least = samples.groupBy("run", "position").agg(F.min("hfd").alias("hfd"))
    a0, a1, a2 = square_fit(F.col("position").cast("double"), F.col("hfd"))
    fit = least.groupBy("run").agg(a0.alias("a0"), a1.alias("a1"), a2.alias("a2"))
    return fit.withColumn("extremum", F.when(F.col("a2") != 0, -0.5 * F.col("a1") / F.col("a2")))


def focus_slope(samples: DataFrame) -> DataFrame:
    """(run, slope, intercept, side): which way the sizes go; rising ones ask for lower positions."""
    least = samples.groupBy("run", "position").agg(F.min("hfd").alias("hfd"))
    slope, intercept = line_fit(F.col("position").cast("double"), F.col("hfd"))
    fit = least.groupBy("run").agg(slope.alias("slope"), intercept.alias("intercept"))
    return fit.withColumn("side", F.when(F.col("slope") > 0, "left").otherwise("right"))


def latest_properties(changes: DataFrame) -> DataFrame:
    """The last change of each (device, prop, elem) by change_id; deleted ones are left out."""
    last = changes.groupBy("device", "prop", "elem").agg(F.max(F.struct("change_id", "change", "value")).alias("c"))
    return last.where("c.change <> 'Delete'").select("device", "prop", "elem", "c.change_id", "c.value")


def offset_by_pairs(low: DataFrame, high: DataFrame) -> DataFrame:
    """The median difference of the pair of shots (low, high) whose deviations are nearest; few shots each, by design."""
    pairs = low.select(F.col("std_dev").alias("s1"), F.col("median").alias("m1")).crossJoin(high.select(F.col("std_dev").alias("s2"), F.col("median").alias("m2")))
    return pairs.agg(F.min(F.struct(F.abs(F.col("s1") - F.col("s2")).alias("d"), (F.col("m2") - F.col("m1")).alias("offset"))).alias("o")).select("o.offset")


def programme(temps: DataFrame, exposures: DataFrame, bins: DataFrame, count: int) -> DataFrame:
    """Every combination of the parameters, each with the count rounded up to a multiple of five."""
    n = -(-count // 5) * 5
    return temps.crossJoin(exposures).crossJoin(bins).withColumn("count", F.lit(n))


def first_good(shots: DataFrame) -> DataFrame:
    """(camera, shot): the first shot of each camera that is ok, which later frames are registered against."""
    return shots.where("ok").groupBy("camera").agg(F.min(F.struct("ts", "shot")).alias("s")).select("camera", "s.shot")


FOCUS = "run long, outcome string, position double, more array<double>"


def focus_result(samples: DataFrame, measures: int, step: float, more: bool = True, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """FOCUS rows: what the samples (run, position, hfd) of each run, few by design, say of where the focus is.

    A parabola is laid through the least size at each position; up to two samples at the ends are left out if that makes its error
    less. With `more` its lowest point counts if it lies in the middle three fifths of the samples ("found"); else the line through
    the samples says whether to measure on the left ("rising") or on the right ("falling"), at the positions of `more`. Without, the
    lowest point counts wherever it lies between low and high. "failed" where nothing can be said.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        s = rows.dropna(subset=["position", "hfd"]).groupby("position")["hfd"].min().sort_index()
        x, y = s.index.to_numpy(float), s.to_numpy(float)
        outcome, position, then = _focus(x, y, measures, step, more, low, high)
        return pd.DataFrame({"run": [rows["run"].iloc[0]], "outcome": [outcome], "position": [position], "more": [then]})

    d = samples.select(F.col("run").cast("long"), F.col("position").cast("double"), F.col("hfd").cast("double"))
    return d.groupBy("run").applyInPandas(one, FOCUS)


def _parabola(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float] | None:
    if len(x) < 3:
        return None
    mid, wide = x.mean(), max(np.ptp(x), 1.0)
    c = np.polyfit((x - mid) / wide, y, 2)
    error = math.sqrt(((np.polyval(c, (x - mid) / wide) - y) ** 2).mean())
    a2 = c[0] / wide**2
    a1 = c[1] / wide - 2 * a2 * mid
    return np.array([a2, a1]), error


def _focus(x: np.ndarray, y: np.ndarray, measures: int, step: float, more: bool, low: float, high: float) -> tuple:
    fit = _parabola(x, y)
    kept = slice(0, len(x))
    for _ in range(2):
        parts = [slice(kept.start + 1, kept.stop), slice(kept.start, kept.stop - 1)]
        tried = [(f, p) for p in parts if (f := _parabola(x[p], y[p]))]
        best = min(tried, key=lambda t: t[0][1], default=None)
        if fit is None or best is None or best[0][1] >= fit[1]:
            break
        fit, kept = best
    lowest = None
    if fit is not None and fit[0][0] > 0:
        at = round(float(-0.5 * fit[0][1] / fit[0][0]), 9)  # binary noise must not move what lies on a half
        lowest = math.copysign(math.floor(abs(at) + 0.5), at)
    if not more:
        return ("found", lowest, []) if lowest is not None and low <= lowest <= high else ("failed", None, [])
    if lowest is not None and x[0] + 0.2 * np.ptp(x) <= lowest <= x[0] + 0.8 * np.ptp(x):
        return "found", lowest, []
    slope = ((x - x.mean()) * (y - y.mean())).sum() if len(x) > 1 else 0.0  # its sign is the line's
    n = (measures + 1) // 2
    if slope > 0:
        return "rising", None, [x[0] - i * step for i in range(n - 1, 0, -1)]
    if slope < 0:
        return "falling", None, [x[-1] + i * step for i in range(1, n)]
    return "failed", None, []
