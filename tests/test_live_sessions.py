"""Streams with state of several variables and timers: growing stacks, autofocus runs and the exposure watchdog."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from stardeck.operators import stacking
from stardeck.streaming import autofocus as af
from stardeck.streaming import live_stack as ls
from stardeck.streaming import watchdog as wd


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    ls.keep_state(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def parts(spark, folder, schema, batches):
    """Each batch as one file; the files' times tell the order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p{k}")
        for f in glob.glob(f"{folder}/p{k}/*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")


def run(df, out, checkpoint, mode="append"):
    """Appends each batch's rows under its own number, so a batch that runs again overwrites itself."""

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


WIDTH, HEIGHT, FRAMES = 7, 3, 11


def frames():
    r = random.Random(2)
    out = []
    for f in range(FRAMES):
        for y in range(HEIGHT):
            row = [None if r.random() < 0.25 else 60_000 if r.random() < 0.1 else r.randint(0, 300) for _ in range(WIDTH)]
            out.append((1, "L", y, f, 90 + f % 4, row))
    return out


def plain_stack(rows, tracks):
    """(y, frame) -> (v, cnt), from lists of all frames so far."""
    out = {}
    for y in range(HEIGHT):
        own = sorted((r for r in rows if r[2] == y), key=lambda r: r[3])
        for n in range(1, len(own) + 1):
            seen = own[:n]
            if tracks:
                cols = [[r[5][x] for r in seen if r[5][x] is not None] for x in range(WIDTH)]
                out[y, seen[-1][3]] = ([sum(c) // len(c) if c else 0 for c in cols], [len(c) for c in cols])
            elif n < 5:
                cols = [[max(r[5][x], 1) for r in seen if r[5][x] is not None] for x in range(WIDTH)]
                out[y, seen[-1][3]] = ([sum(c) // len(c) if c else 0 for c in cols], [0] * WIDTH)
            else:
                sums = [0] * WIDTH
                for k in range(5, n + 1):
                    five = seen[k - 5 : k]
                    common = sorted(r[4] for r in five)[2]
                    for x in range(WIDTH):
                        d = sorted(max(r[5][x], 1) - r[4] for r in five if r[5][x] is not None)
                        m = 0 if not d else d[len(d) // 2] if len(d) % 2 else int((d[len(d) // 2 - 1] + d[len(d) // 2]) / 2)
                        sums[x] += max(m + common, 0)
                out[y, seen[-1][3]] = ([min(s // (n - 4), 65535) for s in sums], [n - 4] * WIDTH)
    return out


@pytest.mark.parametrize("tracks", [True, False])
def test_live_stack_frame_by_frame(spark, tmp_path, tracks):
    rows = frames()
    batches = [[r for r in rows if r[3] in fs] for fs in ((0, 1), (2,), (3, 4, 5, 6), (4, 6), (7, 8, 9), (10,))]  # frames 4 and 6 come twice
    stream = ls.live_stack(parts(spark, f"{tmp_path}/in", ls.BLOCKS, batches), tracks, each=True)
    run(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "update")
    got = {(r["y"], r["frame"]): (list(r["v"]), list(r["cnt"])) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain_stack(rows, tracks)


def test_live_stack_again_and_as_the_batch_operator(spark, tmp_path):
    """The last batch runs again after a lost commit; the end is that of sliding_median()."""
    rows = frames()
    stream = ls.live_stack(parts(spark, f"{tmp_path}/in", ls.BLOCKS, [rows[: 6 * HEIGHT], rows[6 * HEIGHT :]]), tracks=False)
    run(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "update")
    read = lambda: {(r["y"]): (r["frames"], list(r["v"]), list(r["cnt"])) for r in ls.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    before = read()
    for name in ("1", ".1.crc"):
        os.remove(f"{tmp_path}/ck/commits/{name}")
    run(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "update")
    assert read() == before
    blocks = spark.createDataFrame([(r[3], r[2], r[5]) for r in rows], "frame long, y int, row array<int>")
    backgrounds = spark.createDataFrame([(f, 90 + f % 4) for f in range(FRAMES)], "frame long, background int")
    want = {(r["y"], r["x"]): (r["v"], r["cnt"]) for r in stacking.sliding_median(blocks, backgrounds).collect()}
    assert want == {(y, x): (v[x], c[x]) for y, (_, v, c) in before.items() for x in range(WIDTH)}


def test_landed_frames_are_stacked(spark, tmp_path):
    """Frames are moved by batch operators, land as row blocks, and are stacked from there."""
    flat = [(f, y, [10 * f + y] * 4) for f in range(6) for y in range(4)]
    source = parts(spark, f"{tmp_path}/in", "frame long, y int, row array<int>", [flat[:12], flat[12:]])

    def warped(batch):
        offsets = batch.select("frame").distinct().selectExpr("frame", "2e0 dx", "0e0 dy", "0e0 angle")
        w = stacking.warp(batch, offsets, 4, 4).groupBy("frame", "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("a"))
        return w.selectExpr("1L session", "'L' channel", "y", "frame", "0L background", "transform(a, p -> p.v) row")

    q = source.writeStream.foreachBatch(ls.land(f"{tmp_path}/mid", warped)).option("checkpointLocation", f"{tmp_path}/ck1").trigger(availableNow=True).start()
    q.awaitTermination(240)
    run(ls.live_stack(ls.landed(spark, f"{tmp_path}/mid"), tracks=True), f"{tmp_path}/out", f"{tmp_path}/ck2", "update")
    got = {r["y"]: (list(r["v"]), list(r["cnt"])) for r in ls.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {y: ([0, 25 + y, 25 + y, 25 + y], [0, 6, 6, 6]) for y in range(4)}


# --- autofocus --------------------------------------------------------------------------------------------------------


def size_at(position, best=1040.0):
    return 2 + ((position - best) / 150) ** 2


def played(options, size, start=1000.0, most=60):
    """A run against a focuser: each shot it asks for is taken where it is. (images, commands)"""
    machine, images, commands, position = af.Run(start), [], [], start
    shots = 1
    while shots and len(images) < most:
        shots -= 1
        hfd = size(position, len(images))
        images.append((position, hfd))
        for command, where in machine.image(hfd, options):
            commands.append((len(images) - 1, command, where))
            position = where if command == "move" else position
            shots += command == "shot"
    return images, commands, machine


def test_focus_goes_through_both_stages():
    o = af.Options(measures=5, step=100.0, backlash=30.0, shots=2)
    _, commands, machine = played(o, lambda p, _: size_at(p))
    shots = [p for _, c, p in commands if c == "shot"]
    first, second = [800.0, 900.0, 1000.0, 1100.0, 1200.0], [840.0, 940.0, 1040.0, 1140.0, 1240.0]
    assert shots == [p for p in first for _ in range(2)] + [p for p in second for _ in range(2)] + [1040.0]
    assert [p for _, c, p in commands if c == "move"] == [770.0, *first, 810.0, *second, 1010.0, 1040.0]
    assert commands[-1][1:] == ("done", 1040.0) and machine.stage == "done"


def test_focus_asks_for_more_on_the_side_that_falls():
    o = af.Options(measures=5, step=100.0)
    _, commands, machine = played(o, lambda p, _: size_at(p, 640.0))
    shots = [p for _, c, p in commands if c == "shot"]
    assert shots[:7] == [800.0, 900.0, 1000.0, 1100.0, 1200.0, 600.0, 700.0] and machine.target == 640.0
    _, commands, machine = played(o, lambda p, _: size_at(p, 1350.0))
    assert [p for _, c, p in commands if c == "shot"][5:7] == [1300.0, 1400.0] and machine.target == 1350.0


def test_focus_tries_again_without_stars():
    o = af.Options(measures=3, step=100.0, preliminary=False)
    _, commands, _ = played(o, lambda p, n: None if p == 900.0 else size_at(p))
    assert [p for _, c, p in commands if c == "shot"] == [900.0] * 4 + [1000.0, 1100.0, 1000.0]  # two samples are no parabola: it goes back
    _, commands, machine = played(o, lambda p, n: None)
    assert machine.stage == "done" and machine.target == 1000.0
    _, commands, machine = played(af.Options(measures=3, step=100.0, restore=False), lambda p, n: None)
    assert commands[-1][1] == "fail" and machine.stage == "failed"
    _, commands, machine = played(af.Options(measures=5, step=100.0, preliminary=False, high=1030.0), lambda p, n: size_at(p))
    assert machine.target == 1000.0
    assert [af.shots_of(e) for e in (0.5, 3.0, 4.0, 20.0)] == [3, 3, 2, 1]


def test_focus_stream_is_the_replay(spark, tmp_path):
    o = af.Options(measures=5, step=100.0, backlash=10.0)
    rows = []
    for run_id, size in enumerate([lambda p, _: size_at(p), lambda p, n: None if n % 3 == 1 else size_at(p, 650.0), lambda p, n: None]):
        rows += [(run_id, k, p, h) for k, (p, h) in enumerate(played(o, size)[0])]
    schema = "run long, image long, position double, hfd double"
    stream = parts(spark, f"{tmp_path}/in", schema, [[r for r in rows if r[1] < 4], [r for r in rows if 3 <= r[1] < 9], [r for r in rows if r[1] >= 9]])
    run(af.focus_session(stream, o), f"{tmp_path}/out", f"{tmp_path}/ck")
    read = lambda d: sorted(map(tuple, d.select("run", "image", "k", "command", "position").collect()))
    got = read(spark.read.parquet(f"{tmp_path}/out"))
    assert got == read(af.replay(spark.createDataFrame(rows, schema).repartition(3), o))
    assert {r[3] for r in got} == {"move", "shot", "done"}


# --- watchdog ---------------------------------------------------------------------------------------------------------

START = dt.datetime(2024, 1, 1)
CHANGES = "device string, ts timestamp, is_new boolean, before string, after string, value double"


def change(device, second, value, before="Busy", after="Busy", new=False):
    return (device, START + dt.timedelta(seconds=second), new, before, after, value)


CHANGED = [
    change("a", 0, 2.0), change("a", 2, 0.0), change("a", 5, 0.0, after="Ok"),  # the picture came
    change("a", 10, 0.0), change("a", 39, 0.0),  # it didn't: off at 40, on at 42
    change("a", 45, None, new=True),  # back at 45: restart at 50
    change("b", 3, 0.0), change("b", 60, 1.0), change("b", 61, 0.0), change("b", 62, 4.0),  # off at 33, on at 35, failed at 45
    change("c", 1, None, new=True), change("c", 2, 0.0, before="Ok", after="Ok"), change("c", 90, 3.0),
    change("d", 70, 0.0),
]
WANTED = [("a", 40, "switch_off", "shutdown"), ("a", 42, "switch_on", "wait_property"), ("a", 50, "restart_exposure", "waiting"),
          ("b", 33, "switch_off", "shutdown"), ("b", 35, "switch_on", "wait_property"), ("b", 45, "failed", "waiting")]


def actions(d):
    return sorted((r["device"], int((r["at"] - START).total_seconds()), r["action"], r["state"]) for r in d.collect())


def test_watchdog_over_recorded_changes(spark):
    d = spark.createDataFrame(CHANGED, CHANGES)
    assert actions(wd.watched(d, START + dt.timedelta(seconds=95))) == WANTED
    assert actions(wd.watched(d, START + dt.timedelta(seconds=101))) == [*WANTED, ("d", 100, "switch_off", "shutdown")]


@pytest.mark.parametrize("cuts", [(20, 44, 65), (41, 200)])
def test_watchdog_stream(spark, tmp_path, cuts):
    """However the changes are cut into batches, the actions are those of the recorded changes; timers speak for silent devices."""
    edges = [-1, *cuts, 1000]
    batches = [[c for c in CHANGED if a <= (c[1] - START).total_seconds() < b] for a, b in zip(edges, edges[1:], strict=False)]
    batches = [b for b in batches if b] + [[change("e", 96, 1.0)], [change("e", 97, 1.0)]]
    stream = wd.exposure_watchdog(parts(spark, f"{tmp_path}/in", CHANGES, batches))
    run(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert actions(spark.read.parquet(f"{tmp_path}/out")) == WANTED
