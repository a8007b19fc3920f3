"""Operators on small frames against numpy, and that results don't depend on partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stardeck.functions.display import quad_matrix
from stardeck.operators import calibration as cal
from stardeck.operators import catalogue, gradient, registration, stacking, stars
from stardeck.operators import frames as fr


def rows_of(spark, images):
    return spark.createDataFrame([(f, y, [int(v) for v in row]) for f, image in enumerate(images) for y, row in enumerate(image)], "frame long, y int, row array<int>")


def image_of(rows, frame=0):
    return np.array([r["row"] for r in rows.where(F.col("frame") == frame).orderBy("y").collect()])


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).integers(0, 4000, (3, 20, 22))


def test_dark_and_flat(spark, noise):
    rows = rows_of(spark, noise)
    got = image_of(cal.subtract_dark(rows, rows.where("frame = 1")))
    shift = int(noise[0].mean()) - int(noise[1].mean())
    assert np.array_equal(got, np.clip(noise[0] - noise[1] + shift, 0, 65535))
    zero = noise.copy()
    zero[1, 0, 0] = 7
    rows = rows_of(spark, zero)
    got = image_of(cal.apply_flat(rows, rows.where("frame = 1"), 10, 7))
    assert got[0, 0] == zero[0, 0, 0]
    want = np.trunc((zero[0].astype(float) - 10) * 65535 / np.where(zero[1] == 7, 1, zero[1] - 7)) + 10
    assert np.array_equal(got[zero[1] != 7], np.clip(want, 0, 65535)[zero[1] != 7])


def test_repair_needs_rounds(spark):
    image = np.full((9, 9), 100)
    rows = rows_of(spark, [image])
    bad = spark.createDataFrame([(0, y, x) for y in range(2, 7) for x in range(2, 7)], "frame long, y int, x int")
    p = rows.withColumn("row", F.when(F.col("y").between(2, 6), F.transform("row", lambda v, x: F.when(x.between(2, 6), 9999).otherwise(v))).otherwise(F.col("row")))
    got = fr.to_pixels(cal.repair(p, bad, None))
    assert got.where("v <> 100").count() == 0 and got.count() == 81
    assert fr.to_pixels(cal.repair(p, bad, None, rounds=1)).where("v = 9999").count() == 9
    plan = cal.repair(p, bad, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(frame") <= 3  # the rounds don't shuffle anew


@pytest.mark.parametrize("cfa", [None, "RGGB"])
def test_calibration_of_lights(spark, cfa):
    """Subtraction, flat and defects as one, against the same steps in numpy."""
    rng = np.random.default_rng(3)
    h, w = 16, 20
    light, dark, flat = rng.integers(900, 3000, (2, h, w)), rng.integers(90, 110, (h, w)), rng.integers(20000, 30000, (h, w))
    light[:, 7, 8] = 60000
    defects = spark.createDataFrame([(7, 8), (0, 0)], "y int, x int")
    same = lambda y, x, j, i: cfa is None or ("RGGB"[2 * (y % 2) + x % 2] == "RGGB"[2 * (j % 2) + i % 2])

    def near(y, x, reach):
        return [(j, i) for j in range(max(0, y - reach), min(h, y + reach + 1)) for i in range(max(0, x - reach), min(w, x + reach + 1)) if same(y, x, j, i)]

    def repaired(a):
        out = a.copy()
        for y, x in ((7, 8), (0, 0)):
            reach = 1 if cfa is None or (y + x) % 2 else 2
            out[y, x] = np.mean([a[p] for p in near(y, x, reach) if p not in ((7, 8), (0, 0))]) // 1
        return out

    fixed = repaired(flat)
    smooth = np.array([[(sum(fixed[p] for p in near(y, x, 2)) + len(near(y, x, 2)) // 2) // len(near(y, x, 2)) for x in range(w)] for y in range(h)])
    got, done = cal.calibrate(rows_of(spark, list(light)), cfa, w, h, 10, dark=rows_of(spark, [dark]), defects=defects, flat=rows_of(spark, [flat]), flat_offset=50)
    assert done == cal.BY_DARK | cal.BY_FLAT | cal.BY_DEFECTS
    got = {(r["frame"], r["y"]): r["row"] for r in got.collect()}
    for f in (0, 1):
        shift = int(light[f].sum()) // (h * w) - int(dark.sum()) // (h * w)
        a = np.clip(light[f] - dark + shift, 0, 65535)
        a = np.clip(np.trunc((a - 10 - shift) * 65535 / (smooth - 50)).astype(int) + 10 + shift, 0, 65535)
        assert [got[f, y] for y in range(h)] == repaired(a).tolist()


def test_calibration_searches_only_without_a_list(spark):
    frame = np.random.default_rng(1).integers(100, 110, (24, 24))
    frame[12, 11] = 50000
    rows = rows_of(spark, [frame])
    got, done = cal.calibrate(rows, None, 24, 24)
    assert done == cal.BY_SEARCH and max(got.where("y = 12").first()["row"]) < 1000
    got, done = cal.calibrate(rows, None, 24, 24, defects=spark.createDataFrame([], "y int, x int"))
    assert done == cal.BY_DEFECTS and max(got.where("y = 12").first()["row"]) == 50000
    assert cal.calibrate(rows, None, 24, 24, bias=rows, search=False)[1] == cal.BY_BIAS


def test_few_extrema(spark):
    from stardeck.operators import stars as st

    points = spark.createDataFrame([(f, y, 5, 10, 100 * (y + 1)) for f in (1, 2) for y in range(40 if f == 1 else 5)], "frame long, y int, x int, v int, over int")
    t = spark.createDataFrame([(1, 100), (2, 100), (3, 60000)], "frame long, threshold int")
    kept, raised = st.few_extrema(points, t, 10)
    want = 100
    while sum(100 * (y + 1) >= want for y in range(40)) >= 10:
        want = 3 * (want + 1) // 2
    assert {r["frame"]: r["threshold"] for r in raised.collect()} == {1: want, 2: 100, 3: 60000}
    assert kept.where("frame = 1").count() == sum(100 * (y + 1) >= want for y in range(40)) and kept.where("frame = 2").count() == 5
    # no level leaves so few: the last that can be reached stays
    kept, raised = st.few_extrema(points.withColumn("over", F.lit(65535)), t, 1)
    assert raised.where("frame = 1").first()["threshold"] > 40000 and kept.where("frame = 1").count() == 40


def test_demosaic_of_flat_colours(spark):
    y, x = np.mgrid[0:8, 0:10]
    image = np.where((y % 2 == 0) & (x % 2 == 0), 10, np.where((y % 2 == 1) & (x % 2 == 1), 30, 20))
    got = cal.demosaic(rows_of(spark, [image]), 10, 8, "RGGB").collect()
    assert all(set(r["r"]) == {10} and set(r["g"]) == {20} and set(r["b"]) == {30} for r in got)


def test_saturate_keeps_null(spark):
    assert spark.range(1).select(fr.saturate(F.lit(None).cast("int")), fr.saturate(F.lit(70000)), fr.saturate(F.lit(-1))).first() == (None, 65535, 0)


def test_stacks(spark, noise):
    p = fr.to_pixels(rows_of(spark, noise))
    got = {(r["y"], r["x"]): r["v"] for r in stacking.average(p).collect()}
    assert got[3, 4] == (noise[:, 3, 4].sum() + 1) // 3
    few = {(r["y"], r["x"]): r["v"] for r in stacking.average_of_medians(p).collect()}
    assert few == got
    seven = np.concatenate([noise, noise[::-1] + 5, noise[:1]])
    many = {(r["y"], r["x"]): r["v"] for r in stacking.average_of_medians(fr.to_pixels(rows_of(spark, seven))).collect()}
    assert many[3, 4] == np.sort(seven[:5, 3, 4])[2]


def test_warp_of_nothing_moves_nothing(spark, noise):
    rows = rows_of(spark, noise[:1])
    still = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "frame long, dx double, dy double, angle double")
    got = fr.to_rows(stacking.warp(rows, still, 22, 20))
    assert np.array_equal(image_of(got), noise[0])
    moved = spark.createDataFrame([(0, 2.0, -3.0, 0.0)], "frame long, dx double, dy double, angle double")
    at = {(r["y"], r["x"]): r["v"] for r in stacking.warp(rows, moved, 22, 20).collect()}
    assert at[5, 7] == noise[0, 8, 5] and at[0, 0] is None


def test_gradient(spark):
    width, height = 540, 512
    i = spark.range(width * height).selectExpr("0L AS frame", f"cast(id div {width} as int) AS y", f"cast(id % {width} as int) AS x", f"cast(200 + (id % {width}) div 10 as int) AS v")
    out = gradient.remove(i, width, height)
    low, high = out.agg(F.min("v"), F.max("v")).first()
    assert high - low <= 3
    small = i.where("x < 100 AND y < 100")
    assert gradient.remove(small, 100, 100) is small


@pytest.fixture(scope="module")
def sky(spark):
    r = stars.synthetic(spark, 3, 160, 160).cache()
    t = stars.detection_threshold(r)
    found = stars.grow(r, stars.clusters(stars.extrema(r, t, 160, 160)), t).cache()
    return r, found


def test_stars_are_found_where_they_are(sky):
    _, found = sky
    at = [(r["x"], r["y"]) for r in found.where("frame = 0").collect()]
    want = [(160 * (k // 5 * 2 + 1) / 10 + k * 7 % 5, 160 * (k % 5 * 2 + 1) / 10 + k * 3 % 7) for k in range(25)]
    inside = [(x, y) for x, y in want if 17 < x < 143 and 17 < y < 143]
    near = [any(math.dist(p, q) < 1 for q in at) for p in inside]
    assert sum(near) >= 0.9 * len(inside) and len(at) <= 25


def crowded(seed, height=210, width=230, n=60):
    """An image where stars touch, cover one another and lie on borders."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    image = 100 + r.integers(0, 9, (height, width)).astype(float)
    for k in range(n):
        cy, cx = r.uniform(0, height), r.uniform(0, width)
        if k % 3:
            cy, cx = cy // 35 * 35 + r.uniform(-4, 4), cx // 50 * 50 + r.uniform(-4, 4)
        image += r.uniform(300, 20_000) * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * r.uniform(0.8, 4) ** 2))
    return np.clip(image, 0, 65535).astype(int)


@pytest.mark.parametrize("tile", [40, 100, 512])
def test_growth_in_tiles_is_growth_of_the_whole(spark, tile):
    images = [crowded(s) for s in range(3)]
    r = rows_of(spark, images)
    t = spark.createDataFrame([(f, 40) for f in range(3)], "frame long, threshold int")
    centres = stars.clusters(stars.extrema(r, t, 230, 210)).cache()
    got = stars.grow(r, centres, t, tile=tile).orderBy("frame", "star").collect()
    for f, image in enumerate(images):
        order = sorted(((c["y"], c["x"], c["v"]) for c in centres.where(F.col("frame") == f).collect()), key=lambda c: (-c[2], c[0], c[1]))
        want = stars.grow_in(image, order, 40, False)
        mine = [tuple(s)[2:] for s in got if s["frame"] == f]
        assert len(want) > 10 and len(mine) == len(want)
        for a, b in zip(mine, want, strict=True):
            assert a[2:] == tuple(b[2:]) and a[:2] == pytest.approx(b[:2], abs=1e-9)
        assert len(want) < len(order)


def test_growth_gives_up_where_too_much_is_taken(spark):
    image = np.full((60, 60), 100)
    image[4:56:8, 4:56:8] = 9000
    image[5:57:8, 4:56:8] = 8000
    image[4:56:8, 5:57:8] = 8000
    r, t = rows_of(spark, [image]), spark.createDataFrame([(0, 10)], "frame long, threshold int")
    centres = spark.createDataFrame([(0, y, x, 9000) for y in range(4, 56, 8) for x in range(4, 56, 8)], "frame long, y int, x int, v int")
    assert stars.grow(r, centres, t, tile=40).count() == len(stars.grow_in(image, [(y, x, 9000) for y in range(4, 56, 8) for x in range(4, 56, 8)], 10, False)) > 0
    image[:, :40] = 9000
    assert stars.grow(rows_of(spark, [image]), centres, t).count() == len(stars.grow_in(image, [(y, x, 9000) for y in range(4, 56, 8) for x in range(4, 56, 8)], 10, False))
    assert stars.grow(r, centres.where("v < 0"), t).count() == 0


def test_profile_of_patches_is_that_of_the_frame(spark):
    """What measure() gives of the patches is what the whole image gives."""
    image = crowded(5)
    r = rows_of(spark, [image])
    t = spark.createDataFrame([(0, 40)], "frame long, threshold int")
    found = stars.grow(r, stars.clusters(stars.extrema(r, t, 230, 210)), t).cache()
    plain = [tuple(s)[2:] for s in found.orderBy("star").collect() if not s["overexposed"]]
    chosen = stars.profile_stars([(s[0], s[1], s[2], s[3], s[5], s[6]) for s in plain], 230, 210)
    want = stars.sizes(stars.profile([(image, 0, 0)] * len(chosen), chosen, 230, 210))
    got = stars.measure(r, found).first()
    assert (got["hfd"], got["fwhm"], got["ovality"]) == pytest.approx(want) and got["stars"] == found.count()
    nothing = stars.measure(rows_of(spark, [image, image]), found).where("frame = 1").first()
    assert tuple(nothing) == (1, 0, None, None, None)


def test_star_sizes(sky):
    m = stars.measure(*sky).where("frame = 0").first()
    assert 1.8 < m["fwhm"] < 3.2 and 1.5 < m["hfd"] < 4 and m["ovality"] < 1


def test_offsets(sky):
    _, found = sky
    o = {r["frame"]: r for r in registration.offsets(found.where("frame = 0"), found, 160, 160).collect()}
    assert all(o[k]["x"] == pytest.approx(k, abs=0.2) and o[k]["y"] == pytest.approx(k, abs=0.2) and abs(o[k]["angle"]) < 0.01 for k in (0, 1, 2))


def test_offsets_with_a_turn_and_without_agreement(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(20, 480, (40, 2))
    c, s, mid = math.cos(0.3), math.sin(0.3), 249.5
    turned = [(mid + (x - mid) * c - (y - mid) * s + 4, mid + (y - mid) * c + (x - mid) * s - 2) for x, y in p]
    other = rng.uniform(20, 480, (4, 2))
    rows = [(f, float(x), float(y), float(100 - k)) for f, q in enumerate((p, turned, other)) for k, (x, y) in enumerate(q)]
    d = spark.createDataFrame(rows, "frame long, x double, y double, brightness double")
    o = {r["frame"]: r for r in registration.offsets(d.where("frame = 0"), d, 500, 500).collect()}
    assert o[1]["angle"] == pytest.approx(0.3, abs=1e-3) and o[2]["x"] is None


def test_library_calibrates_as_each_setting_alone(spark, tmp_path):
    """Frames of two settings by the masters of their time; one that comes between batches counts from then on."""
    from stardeck.operators import library

    rng = np.random.default_rng(23)
    h, w, cfa = 24, 26, "RGGB"

    def dark(level, y, x):
        d = rng.integers(level, level + 20, (h, w))
        d[y, x] = 60_000
        return d

    made = {1: ("dark", "a", 0, dark(100, 5, 7)), 2: ("dark", "b", 0, dark(300, 11, 3)), 3: ("flat", "a", 1, rng.integers(30_000, 40_000, (h, w))), 4: ("bias", "c", 0, dark(50, 2, 2)), 5: ("dark", "a", 10, dark(140, 20, 20))}
    lights = {10: ("a", 5), 11: ("b", 5), 12: ("c", 5), 13: ("d", 5), 14: ("a", 12), 15: ("a", 0)}
    images = {f: rng.integers(1000, 9000, (h, w)) for f in lights}
    masters = lambda ids: spark.createDataFrame([(m, made[m][0], made[m][1], made[m][2], 50, y, [int(v) for v in row]) for m in ids for y, row in enumerate(made[m][3])], "master long, kind string, setting string, since long, offset int, y int, row array<int>")
    blocks = lambda fs: spark.createDataFrame([(f, y, [int(v) for v in row], *lights[f], 10) for f in fs for y, row in enumerate(images[f])], "frame long, y int, row array<int>, setting string, time long, offset int")
    kept = library.Library(spark, f"{tmp_path}/lib", w, h, cfa)
    write = kept.calibrating(f"{tmp_path}/out")
    write(blocks([10]), 0)  # nothing is there yet
    kept.add(masters([1, 2, 4]))
    kept.add(masters([3]))
    write(blocks([10, 11, 12, 13, 14, 15]), 1)
    kept.add(masters([5]))
    write(blocks([14]), 2)
    image = lambda n, f: image_of(spark.read.parquet(f"{tmp_path}/out/batch={n}"), f)
    done = {(r["batch"], r["frame"]): r["done"] for r in spark.read.parquet(f"{tmp_path}/out").select("batch", "frame", "done").distinct().collect()}

    def alone(f, **by):
        out, bits = cal.calibrate(rows_of(spark, [images[f]]), cfa, w, h, 10, **{k: rows_of(spark, [made[m][3]]) for k, m in by.items()}, **({"flat_offset": 50} if "flat" in by else {}), search=False)
        return image_of(out), bits

    for n, f, by in [(0, 10, {}), (1, 10, {"dark": 1, "flat": 3}), (1, 11, {"dark": 2}), (1, 12, {"bias": 4}), (1, 13, {}), (1, 14, {"dark": 1, "flat": 3}), (1, 15, {"dark": 1}), (2, 14, {"dark": 5, "flat": 3})]:
        want, bits = alone(f, **by)
        if n == 2:  # the flat was made ready when the first dark was the one of its time
            bad = cal.hot_in_dark(rows_of(spark, [made[1][3]]), w, h).select("y", "x")
            flat = cal.smooth_flat(cal.repair(rows_of(spark, [made[3][3]]), bad, cfa), cfa)
            d = cal.subtract_dark(rows_of(spark, [images[f]]), rows_of(spark, [made[5][3]]))
            d = cal.apply_flat(d, flat, F.col("shift") + 10, 50)
            want = image_of(cal.repair(d, cal.hot_in_dark(rows_of(spark, [made[5][3]]), w, h).select("y", "x"), cfa))
        assert np.array_equal(image(n, f), want), (n, f)
        assert done[n, f] == bits, (n, f)


@pytest.mark.parametrize("cfa", [None, "GRBG"])
def test_bands_of_any_height_give_the_same(spark, cfa):
    """Stencils over bands of 3 rows are those over whole frames, and of 7 x 5 neighbours in plain Python."""
    rng = np.random.default_rng(17)
    images = rng.integers(0, 4000, (2, 23, 19))
    images[0, 11, 9] = images[1, 3, 3] = 65000
    r = rows_of(spark, list(images)).repartition(3)
    bad = spark.createDataFrame([(f, int(y), int(x)) for f in range(2) for y in range(5, 18) for x in range(6, 12)] + [(1, 0, 0), (1, 22, 18), (0, 99, 1), (0, 1, 99)], "frame long, y int, x int")
    every = bad.where("frame = 0").select("y", "x")
    table = lambda d: sorted(map(str, d.collect()))
    for make in (lambda n: cal.smooth_flat(r, cfa, n), lambda n: cal.repair(r, bad, cfa, band=n), lambda n: cal.repair(r, every, cfa, band=n), lambda n: cal.hot_in_light(r, cfa, band=n), lambda n: cal.demosaic(r, 19, 23, cfa or "RGGB", n)):
        assert table(make(3)) == table(make(64))
    near = {"L": lambda d, e: True, "G": lambda d, e: (d + e) % 2 == 0, "RB": lambda d, e: d % 2 == 0 and e % 2 == 0}
    got = {(x["frame"], x["y"]): x["row"] for x in cal.smooth_flat(r, cfa, 3).collect()}
    for f, y, x in [(0, 0, 0), (0, 11, 9), (1, 22, 18), (1, 2, 1), (0, 12, 4), (1, 13, 17)]:
        kind = "L" if cfa is None else "G" if (y + x) % 2 == 0 else "RB"
        v = [images[f, y + d, x + e] for d in range(-2, 3) for e in range(-2, 3) if 0 <= y + d < 23 and 0 <= x + e < 19 and near[kind](d, e)]
        assert got[f, y][x] == (sum(v) + len(v) // 2) // len(v)


def test_no_pixel_is_shuffled(spark, noise):
    """Nothing is exploded below the last exchange of the stacks and of the flats' normalisation."""
    r = rows_of(spark, list(noise) if noise.ndim == 3 else [noise])
    for d in (stacking.average(r), stacking.average_of_medians(spark.range(5).selectExpr("id frame").crossJoin(r.drop("frame"))), cal.normalize_flat(r, "RGGB")):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_rows_of_unlike_lengths_and_nulls_are_summed(spark):
    rows = [(0, 0, [1, None, 5]), (1, 0, [2, 4]), (2, 0, None), (3, 1, [])]
    got = sorted(map(tuple, stacking.average(spark.createDataFrame(rows, "frame long, y int, row array<int>")).collect()))
    assert got == [(0, 0, 2), (0, 1, 4), (0, 2, 5)]


def test_results_do_not_depend_on_partitions(spark, noise):
    p = fr.to_pixels(rows_of(spark, noise))
    results = []
    for n in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        h = fr.histogram(p.repartition(int(n)), "frame")
        results.append(sorted(map(tuple, fr.ranked(h, ["frame"], {"m": fr.median_rank(F.col("count"))}).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2] == [(f, int(np.sort(noise[f], axis=None)[noise[f].size // 2])) for f in range(3)]


def test_search_ranks_and_dedupes(spark):
    named = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = catalogue.search(" M 31 ", named("Andromeda"), named("M31", "M 310", "NGC 1 (M 31)", "Other"), named("M 31", "m 31 b"))
    assert sorted((r["stage"], r["kind"], r["name"]) for r in got.collect()) == [(1, "dso", "M31"), (2, "star", "M 31"), (4, "dso", "M 310"), (5, "star", "m 31 b"), (7, "dso", "NGC 1 (M 31)")]
    assert catalogue.search("  ", named("a"), named("b"), named("c")).count() == 0


def test_a_quadrilateral_leaves_out_what_a_frame_lacks(spark, noise):
    """A frame without its last rows, and one with a shorter row, give no places for them."""
    rows = rows_of(spark, noise)
    whole = stacking.onto_quad(rows, [(0, 0), (22, 0), (22, 20), (0, 20)], 22, 20)
    assert whole.where("frame = 0").count() == 22 * 20 and whole.where("v IS NULL").count() == 0
    less = rows.where("frame <> 1 OR y < 7").withColumn("row", F.when(F.expr("frame = 2 AND y = 3"), F.slice("row", 1, 5)).otherwise(F.col("row")))
    got = stacking.onto_quad(less, [(0, 0), (22, 0), (22, 20), (0, 20)], 22, 20)
    assert got.where("v IS NULL").count() == 0
    assert [got.where(f"frame = {k}").count() for k in range(3)] == [22 * 20, 22 * 7, 22 * 20 - 17]


def test_places_of_a_quadrilateral_do_not_grow_with_the_frames(spark, monkeypatch):
    """Places are broadcast once, whatever the number of frames, and no pixel is shuffled; a large picture's are not broadcast."""
    rows = spark.range(4000 * 20).selectExpr("id div 20 AS frame", "cast(id % 20 AS int) AS y", "transform(sequence(0, 21), x -> cast(id * 22 + x AS int)) AS row")
    corners = [(1, 2), (24, 0), (20, 21), (-3, 17)]
    # 4 MB are enough for the 616 places of the box, not for those of all frames (192 MB)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4mb")
    try:
        got = stacking.onto_quad(rows, corners, 22, 20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        sums = got.groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.col("v") - F.col("frame") * 440).alias("s")).groupBy("n", "s").count().collect()
        one = sorted(map(tuple, got.where("frame = 3999").collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        monkeypatch.setattr(stacking, "PLACES", 100)
        large = stacking.onto_quad(rows.where("frame >= 3998"), corners, 22, 20)
        assert "BroadcastExchange" not in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, large.where("frame = 3999").collect())) == one
    finally:
        for key in ("spark.sql.maxBroadcastTableSize", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastExchange") == 1
    m = np.array(quad_matrix(corners, 22, 20))
    want = []
    for ty in range(22):
        for tx in range(-3, 25):
            x, y, w = m @ (tx, ty, 1)
            x, y = int(round(x / w, 9)), int(round(y / w, 9))
            if 0 <= x < 22 and 0 <= y < 20:
                want.append((3999, ty, tx, 3999 * 440 + y * 22 + x))
    assert one == sorted(want) and len(want) > 300
    assert [tuple(r) for r in sums] == [(len(want), sum(w[3] - 3999 * 440 for w in want), 4000)]


def test_triangles_match_without_a_shuffle_of_them(spark):
    """Every similar pair is found once, as by brute force; the reference's triangles go to the others."""
    rng = np.random.default_rng(11)
    rows = [(f, float(x), float(y), float(k)) for f in range(3) for k, (x, y) in enumerate(rng.uniform(0, 60, (12, 2)) + (1e7 if f == 2 else 0))]
    t = registration.triangles(registration.brightest(spark.createDataFrame(rows, "frame long, x double, y double, brightness double"), 12), 10.0)
    m = registration.matches(t.where("frame = 0"), t.where("frame > 0"), 2.5)
    all_of = [(r["frame"], r["i"], r["j"], r["k"], np.array([r["a"], r["b"], r["c"]]), r["len"]) for r in t.collect()]
    want = [(*o[:4], *r[1:4]) for o in all_of for r in all_of if o[0] > 0 and r[0] == 0 and r[5] - 2.5 <= o[5] < r[5] + 2.5 and ((o[4] - r[4]) ** 2).sum() < 6.25]
    assert sorted(tuple(r[c] for c in ("frame", "i", "j", "k", "ri", "rj", "rk")) for r in m.collect()) == sorted(want) and len(want) > 100
    joins = m._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" not in joins
