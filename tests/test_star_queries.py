"""Queries over frames made of a table's rows take all of them."""

import numpy as np
import pytest

from stardeck.plans import star_queries as sq

FRAMES = 6


@pytest.fixture(scope="module")
def sky(spark, tmp_path_factory):
    """A folder with 6 frames of 25 vectors, and their vectors."""
    e = np.random.default_rng(8).uniform(-0.15, 0.15, (25 * FRAMES, 4))
    folder = str(tmp_path_factory.mktemp("sky"))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, e


def test_every_frame_is_measured(spark, sky):
    got = {r["frame"]: r["stars"] for r in sq.star_metrics(spark, sky[0]).collect()}
    assert sorted(got) == list(range(FRAMES)) and min(got.values()) >= 9


def test_every_frame_is_registered(spark, sky):
    moved = np.clip(32 * sky[1][::25, :2], -6, 6)
    got = {r["frame"]: r for r in sq.frame_offset(spark, sky[0]).collect()}
    assert sorted(got) == list(range(FRAMES))
    for f, r in got.items():
        assert (r["x"], r["y"]) == pytest.approx(tuple(moved[f] - moved[0]), abs=0.3) and abs(r["angle"]) < 0.01


def test_every_gradient_is_removed(spark, tmp_path):
    slopes = {0: (0.1, 0.0), 1000: (-0.4, 0.3), 2999: (0.6, -0.2)}
    spark.createDataFrame([(i, list(v)) for i, v in slopes.items()], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = sq.gradient_remove(spark, str(tmp_path)).collect()
    for frame in range(3):
        mine = [r for r in rows if r["frame"] == frame]
        assert len(mine) == 512 and max(r["high"] for r in mine) - min(r["low"] for r in mine) <= 10 + 4


def test_frames_of_stars_are_drawn_in_tasks(spark, tmp_path):
    """Pixels as the formula has them, with Spark's hashes as noise; no function is interpreted for each pixel."""
    import math

    from pyspark.sql import functions as F

    from stardeck.plans import star_queries as q

    rows = [(k, [0.05, -0.03, 0.1 * (k % 3)]) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    frames = q.star_frames(spark, str(tmp_path))
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan
    got = {(r["frame"], r["y"]): r["row"] for r in frames.collect()}
    assert len(got) == 2 * q.SIZE
    noise = spark.range(q.SIZE).selectExpr("cast(id AS int) AS x").select("x", F.expr("pmod(xxhash64(0L, 11, x), 9)").alias("n")).collect()
    stars = [(32 * (k // 5) + 6 + (5 * k * k + 3 * k) % 19, 32 * (k % 5) + 5 + (3 * k * k + 11 * k) % 23, 4500 + 80 * k + 1000 * rows[k][1][2]) for k in range(25)]
    dx, dy = 32 * 0.05, 32 * -0.03
    for x, n in noise:
        near = [(a, (x - sx - dx) ** 2 + (11 - sy - dy) ** 2) for sx, sy, a in stars]
        assert abs(got[0, 11][x] - int(sum(a * math.exp(-d / 2) for a, d in near if d <= 18) + 100 + n)) <= 1
