"""The stream forms give what the batch forms give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stardeck.operators import sessions
from stardeck.streaming import shots as st


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shots"))
    start = dt.datetime(2024, 1, 1)
    for part in range(3):
        rows = [(k % 2, k, start + dt.timedelta(minutes=k), 10.0 + k % 4, None if k % 7 == 0 else 20 + k / 10, 2 + k * 5 % 7 / 10, k % 5 > 0) for k in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(rows, st.SHOT).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_dither(spark, folder):
    batch = sorted(map(tuple, sessions.dither(spark.read.parquet(folder), 50.0).collect()))
    assert streamed(spark, st.dither(st.read_shots(spark, folder, 1), 50.0), "dither") == batch
    assert any(r[2] for r in batch)


def test_refocus(spark, folder):
    batch = sorted(map(tuple, sessions.refocus(spark.read.parquet(folder), 150.0, 2.0, 30).collect()))
    assert streamed(spark, st.refocus(st.read_shots(spark, folder, 1), 150.0, 2.0, 30), "refocus") == batch
    assert any(r[2] for r in batch) and not all(r[2] for r in batch)


def test_first_good(spark, folder):
    assert streamed(spark, st.first_good(st.read_shots(spark, folder, 1)), "first") == [(0, 2), (1, 1)]


def test_windows(spark, folder):
    got = streamed(spark, st.exposure_windows(st.read_shots(spark, folder, 1)).select("camera", "start", "good"), "windows")
    assert got and all(r[2] <= 5 for r in got)


def test_properties(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "device string, prop string, elem string, change_id long, change string, value double"
    for part in ([("a", "p", "e", 1, "New", 1.0), ("b", "p", "e", 2, "New", 2.0)], [("a", "p", "e", 3, "Change", 5.0), ("b", "p", "e", 4, "Delete", None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(st.upsert_properties(target)).trigger(availableNow=True).start().awaitTermination(120)
    last = sessions.latest_properties(spark.read.parquet(f"{target}/1")).collect()
    assert [tuple(r) for r in last] == [("a", "p", "e", 3, 5.0)]


def test_guider(spark):
    lines = ['{"Event":"GuideStep","Timestamp":1.5,"dx":0.1}', '{"Event":"AppState","State":"Paused"}', '{"Event":"SettleDone","Status":0}', '{"Event":"SettleDone","Status":1,"Error":"late"}', '{"jsonrpc":"2.0","id":3,"error":{"code":1,"message":"no"}}', "junk"]
    got = st.guider_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["event"], r["state"], r["outcome"], r["message"]) for r in got] == [
        ("GuideStep", "Guiding", None, None), ("AppState", "Paused", None, None), ("SettleDone", None, "DitheringFinished", None), ("SettleDone", None, "DitheringFailed", "late"), (None, None, "Error", "no"),
    ]
    dx, dy = st.guide_correction(F.lit(3.0), F.lit(1.0), F.lit(2.0), 2.0)
    assert tuple(spark.range(1).select(dx, dy).first()) == (0.5, 1.0)


def test_live_stack(spark, tmp_path):
    """A stack that grows batch by batch is the average of all frames, also when a batch is run again."""
    import os

    from stardeck.operators import stacking

    frames = [[[1, 2], [3, None]], [[5, 7], [9, 11]], [[2, 2], [2, 2]]]
    rows = [(f, y, r) for f, frame in enumerate(frames) for y, r in enumerate(frame)]
    path = f"{tmp_path}/stack"
    write = stacking.add_to_stack(path)
    for n, f in enumerate((0, 1, 2, 2)):  # the third batch comes twice
        write(spark.createDataFrame([r for r in rows if r[0] == f], "frame long, y int, row array<int>"), min(n, 2))
    got = {(r["y"], r["x"]): (r["v"], r["cnt"]) for r in stacking.stacked(spark, path, 2).collect()}
    want = {}
    for y in range(2):
        for x in range(2):
            v = [frame[y][x] for frame in frames if frame[y][x] is not None]
            want[y, x] = (sum(v) // len(v), len(v))
    assert got == want
    assert sorted(os.listdir(path)) == ["1", "2"]


def test_shots_meet_the_masters_of_a_library(spark, folder):
    from stardeck.operators import devices

    masters = spark.createDataFrame([(0, "dark_0"), (5, "dark_5")], "key long, master string")
    keyed = st.read_shots(spark, folder, 1).withColumn("key", F.col("camera"))
    got = streamed(spark, devices.shots_with_masters(keyed, masters).select("camera", "shot", "master"), "masters")
    assert got == sorted(((k % 2, k, "dark_0" if k % 2 == 0 else None) for k in range(60)), key=lambda r: (r[0], r[1]))
