"""Ordered passes over shots, moves and frames against plain Python, however the rows are dealt."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stardeck.operators import sessions, stacking
from stardeck.operators.spans import numbered

SHOT = "camera long, shot long, ts timestamp, exposure double, temp double, fwhm double, ok boolean"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def shots():
    rnd, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3]), k, start + dt.timedelta(minutes=rnd.randrange(90)), rnd.choice([5.0, 20.0, 40.5]), rnd.choice([None, 20.0, 21.5, 24.0]), rnd.choice([None, 2.0, 2.5, 3.9]), rnd.random() > 0.2) for k in range(300)]
    return [*rows, (1, 300, None, 30.0, 20.0, 2.0, True)]


def in_order(shots):
    for camera in (None, 1, 2, 3):
        yield camera, sorted((r for r in shots if r[0] == camera), key=lambda r: (r[2] is None, r[2] or 0, r[1]))


@pytest.mark.parametrize(("batch", "span"), [(7, 1 << 18), (10_000, 9), (5, 40)])
def test_sessions_pass_in_batches_and_spans(spark, shots, batch, span):
    key, table = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame(shots, SHOT)
    held = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        moves, focus = sessions.dither(table, 100.0, span), sessions.refocus(table, 400.0, 3.0, 80, span)
        assert "FlatMapGroupsInPandas" not in plan(moves) + plan(focus)  # that would hold a camera whole
        got = [{(r[0], r[1]): r[2] for r in df.collect()} for df in (moves, focus)]
    finally:
        spark.conf.set(key, held)
    want = [{}, {}]
    for camera, rows in in_order(shots):
        fired, _ = sessions.accumulate(np.array([r[3] for r in rows]), 100.0)
        state = sessions.RefocusState()
        for r, f in zip(rows, fired, strict=True):
            want[0][camera, r[1]] = bool(f)
            want[1][camera, r[1]] = bool(state.add(*r[3:], 400.0, 3.0, 80))
    assert got == want


@pytest.mark.parametrize("span", [3, 64])
def test_dither_keeps_its_phase_over_spans(spark, span):
    """Equal exposures never bring two phases together; a camera with all shots is in many spans."""
    start = dt.datetime(2024, 1, 1)
    rows = [(1, k, start + dt.timedelta(seconds=k), 0.1 if k % 50 else 0.0, None, None, True) for k in range(500)]
    df = spark.createDataFrame(rows, SHOT)
    for period in (0.7, 30.0, 0.1, 1e9):
        want, total = [], 0
        for r in rows:
            total += round(r[3] * 1_000_000)
            want.append(total >= round(period * 1_000_000))
            total = 0 if want[-1] else total
        assert [r["dither"] for r in sessions.dither(df, period, span).orderBy("shot").collect()] == want
    dealt_rows = sessions._in_spans(df, {"e": F.col("exposure")}, span)
    sizes = [r["count"] for r in dealt_rows.groupBy("_span").count().collect()]
    assert len(sizes) >= 500 // span and max(sizes) <= 2 * span


@pytest.mark.parametrize(("span", "equal"), [(64, True), (30, False)])
def test_dither_without_a_unit_adds_doubles(spark, span, equal):
    """Sums that reach the period in decimals, but not in doubles, or that do so by their phase only."""
    start, rnd = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [(c, k, start + dt.timedelta(seconds=k), 0.1 if equal else rnd.choice([0.1, 0.2, 0.3, 0.7]), None, None, True) for c in (1, 2) for k in range(700)]
    df = spark.createDataFrame(rows, SHOT)
    for period in (0.8, 7.7, 1e9):
        want = [f for c in (1, 2) for f in sessions.accumulate(np.array([r[3] for r in rows if r[0] == c]), period)[0]]
        assert [r["dither"] for r in sessions.dither(df, period, span, unit=None).orderBy("camera", "shot").collect()] == want
    exact = [r["dither"] for r in sessions.dither(df, 0.8, span).orderBy("camera", "shot").collect()]
    assert exact != [r["dither"] for r in sessions.dither(df, 0.8, span, unit=None).orderBy("camera", "shot").collect()]


@pytest.mark.parametrize("span", [4, 1000])
def test_refocus_that_forgets_nothing(spark, span):
    """Without a reset every span has to wait for the one before it."""
    start = dt.datetime(2024, 1, 1)
    rows = [(1, k, start + dt.timedelta(seconds=k), 1.0, None if k < 11 else 20.0 + k / 10, 2.0, True) for k in range(30)]
    got = [r["refocus"] for r in sessions.refocus(spark.createDataFrame(rows, SHOT), 0.0, 1.5, 80, span).orderBy("shot").collect()]
    state = sessions.RefocusState()
    assert got == [state.add(*r[3:], 0.0, 1.5, 80) for r in rows] and any(got)


@pytest.mark.parametrize("span", [5, 1 << 18])
def test_running_sums_in_spans(spark, shots, span):
    got = {(r["camera"], r["shot"]): (r["total"], r["ok_count"]) for r in sessions.with_running_exposure(spark.createDataFrame(shots, SHOT), span).collect()}
    want = {}
    for camera in (None, 1, 2, 3):
        total, good = 0.0, 0
        for r in sorted((r for r in shots if r[0] == camera), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            total, good = total + r[3], good + r[6]
            want[camera, r[1]] = (total, good)
    assert got == want


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_numbers_and_rows_before(spark, span):
    rows = [(None if k % 5 == 0 else "ab"[k % 2], k * k % 409 if k != 7 else None, k) for k in range(150)]
    rows = list({(a, n): (a, n, v) for a, n, v in rows}.values())
    got = {(r["a"], r["n"]): (r["_k"], r["_before"] and r["_before"]["v"]) for r in numbered(spark.createDataFrame(rows, "a string, n long, v long"), "n", "a", ("v",), span).collect()}
    want = {}
    for a in (None, "a", "b"):
        mine = sorted((r for r in rows if r[0] == a), key=lambda r: (r[1] is not None, r[1] or 0))
        want |= {(a, r[1]): (i + 1, mine[i - 1][2] if i else None) for i, r in enumerate(mine)}
    assert got == want


@pytest.mark.parametrize("span", [3, 1000])
def test_axis_calibration(spark, span):
    moves = [("ra" if k % 3 else "dec", k, float(k * 31 % 97), float(k * 57 % 89), 10.0 + k % 4) for k in range(120)]
    df = sessions.axis_calibration(spark.createDataFrame(moves, "axis string, n long, x double, y double, seconds double"), span)
    assert "windowspecdefinition(axis" not in plan(df)  # that would send an axis to one task
    got = {r["axis"]: (r["moves"], round(r["speed"], 9)) for r in df.collect()}
    for axis, skip in (("ra", 1), ("dec", 2)):
        m = [r for r in moves if r[0] == axis]
        d = [(math.hypot(b[2] - a[2], b[3] - a[3]), b[4]) for a, b in zip(m, m[1:])][skip - 1 :]
        far = [(x, s) for x, s in d if x > 0.5 * max(d)[0]]
        assert got[axis] == (len(far), round(sum(x for x, _ in far) / sum(s for _, s in far), 9))


@pytest.mark.parametrize("span,together", [(2, 256), (1000, 5)])
def test_frames_are_numbered_in_spans(spark, span, together, monkeypatch):
    monkeypatch.setattr(stacking, "TOGETHER", together)
    v = np.random.default_rng(6).integers(0, 4000, (13, 3))
    p = spark.createDataFrame([(3 * f, 0, x, int(v[f, x])) for f in range(13) for x in range(3)], "frame long, y int, x int, v int")
    medians = np.array([np.sort(v[i : i + 5], axis=0)[2] for i in (0, 5)])
    got = stacking.average_of_medians(p, span)
    assert {r["x"]: r["v"] for r in got.collect()} == dict(enumerate(((medians.sum(axis=0) + 1) // 2).tolist()))
    back = [int(np.sort(v[f])[1]) for f in range(13)]
    b = spark.createDataFrame([(3 * f, back[f]) for f in range(13)], "frame long, background int")
    rows = spark.createDataFrame([(3 * f, 0, v[f].tolist()) for f in range(13)], "frame long, y int, row array<int>")
    out = {r["x"]: (r["v"], r["cnt"]) for r in stacking.sliding_median(rows, b, span).collect()}
    for x in range(3):
        o = [max(0, sorted(max(int(v[g, x]), 1) - back[g] for g in range(f - 4, f + 1))[2] + sorted(back[f - 4 : f + 1])[2]) for f in range(4, 13)]
        assert out[x] == (sum(o) // 9, 9)


def test_focus_result(spark):
    runs = {
        1: [(x, 1 + ((x - 1030) / 100) ** 2) for x in range(900, 1200, 50)],
        2: [(x, 1 + ((x - 1190) / 100) ** 2) for x in range(900, 1200, 50)],
        3: [(x, 1 + ((x - 700) / 100) ** 2) for x in range(900, 1200, 50)],
        4: [(1000, 3.0)],
        5: [(x, 1 + ((x - 1030) / 100) ** 2 + (40 if x == 900 else 0)) for x in range(900, 1200, 50)],  # a bad sample at the end is left out
        6: [(1000, 2.0), (1000, None), (1050, 2.0)],
    }
    samples = spark.createDataFrame([(r, float(x), y) for r, xs in runs.items() for x, y in xs], "run long, position double, hfd double")
    got = {r["run"]: (r["outcome"], r["position"], r["more"]) for r in sessions.focus_result(samples, 5, 50.0).collect()}
    assert got[1] == got[5] == ("found", 1030.0, [])
    assert got[2] == ("falling", None, [1200.0, 1250.0]) and got[3] == ("rising", None, [800.0, 850.0])
    assert got[4] == got[6] == ("failed", None, [])
    last = {r["run"]: (r["outcome"], r["position"]) for r in sessions.focus_result(samples, 5, 50.0, more=False, low=800, high=2000).collect()}
    assert last[2] == ("found", 1190.0) and last[3] == ("failed", None)
