"""Golden values of the scalar functions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from stardeck.functions import display, epochs, numeric, sky, text
from stardeck.functions.sky import lit


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_medians(spark):
    for n in (3, 5, 7):
        rows = spark.createDataFrame([(list(p),) for p in itertools.islice(itertools.permutations(range(1, n + 1)), 300)], "a array<int>")
        assert {r[0] for r in rows.select(numeric.upper_median(F.col("a"))).collect()} == {n // 2 + 1}
    a = [F.lit(x) for x in (1, 3, 5, 8)]
    assert one(spark, numeric.median4_up(*a), numeric.median4_to_zero(*[-x for x in a])) == (4, -4)
    assert one(spark, numeric.median4_up(*[F.lit(x) for x in (1, 4, 5, 7)])) == 5
    assert one(spark, numeric.upper_median(F.array(*a))) == 5


def test_solvers(spark):
    assert one(spark, *numeric.solve2(*[lit(x) for x in (3, 2, 16, 2, -1, 6)])) == (4, 2)
    assert one(spark, *numeric.solve2(*[lit(x) for x in (1, 2, 35, 1, 1, 31)])) == (27, 4)
    assert one(spark, *numeric.solve2(*[lit(x) for x in (1, 1, 1, 2, 2, 2)])) == (None, None)
    m = [[lit(x) for x in r] for r in ((2, 1, 1), (1, 3, 2), (1, 0, 0))]
    assert one(spark, *numeric.solve3(m, [lit(7), lit(13), lit(1)])) == pytest.approx((1, 2, 3))


def test_fits(spark):
    d = spark.createDataFrame([(x, 2 * x * x - 3 * x + 1) for x in (0.0, 1.0, 2.0, 5.0)], "x double, y double")
    assert tuple(d.agg(*numeric.square_fit(F.col("x"), F.col("y"))).first()) == pytest.approx((1, -3, 2))
    points = [(1.0, 2.0, 3.0), (11.0, -3.0, 2.9), (6.0, 5.0, 3.1)]
    a, b, c = spark.createDataFrame(points, "x double, y double, z double").agg(*numeric.plane_fit(F.col("x"), F.col("y"), F.col("z"))).first()
    assert all(abs(a * x + b * y + z + c) < 1e-9 for x, y, z in points)


def test_polygon(spark):
    square = F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    for x, y, want in ((0.5, 0.5, True), (1.5, 0.5, False), (1, 0.5, True), (0, 0, True), (-0.1, 0, False), (0.5, 1, True)):
        assert one(spark, numeric.in_polygon(square, lit(x), lit(y))) == want
    assert one(spark, numeric.in_polygon(F.slice(square, 1, 2), lit(0), lit(0))) is False


def test_sky(spark):
    for ra, dec in ((0.1, 0.2), (3, -1), (6, 1.5), (1, 0)):
        assert one(spark, *sky.from_vector(*sky.to_vector(lit(ra), lit(dec)))) == pytest.approx((ra, dec), abs=1e-9)
        h = sky.to_horizon(lit(ra), lit(dec), lit(2.5), lit(0.3), lit(0.9))
        assert one(spark, *sky.from_horizon(*h, lit(2.5), lit(0.3), lit(0.9))) == pytest.approx((ra, dec), abs=1e-9)
    assert one(spark, sky.angle_between(lit(0), lit(0), lit(math.pi / 2), lit(0))) == pytest.approx(math.pi / 2)
    assert one(spark, sky.altitude(lit(1), lit(0.5), lit(1), lit(0), lit(0.5))) == pytest.approx(math.pi / 2, abs=1e-6)
    assert one(spark, sky.julian_day(F.lit("2001-01-01").cast("date"))) == 2451911
    assert one(spark, sky.julian_time(F.lit("2000-01-01 12:00:00").cast("timestamp"))) == 2451545
    assert one(spark, *sky.zone(lit(0), lit(math.pi / 2))) == (40, 40)
    assert one(spark, *sky.zone(lit(0.1), lit(0))) == (0, 20)


def test_bodies(spark):
    d = spark.createDataFrame([(0.0,)], "t double")
    ra, dec = d.select(*sky.sun(F.col("t"))).first()
    assert math.degrees(ra) == pytest.approx(281.3, abs=0.5) and math.degrees(dec) == pytest.approx(-23.0, abs=0.2)
    m = sky.with_moon(d).first()
    assert math.degrees(m["moon_ra"]) == pytest.approx(222.4, abs=1) and math.degrees(m["moon_dec"]) == pytest.approx(-10.9, abs=1)
    assert 0.15 < d.select(sky.moon_phase(F.col("t"))).first()[0] < 0.35


def test_sexagesimal(spark):
    for s, want in (("10:30.3", 10.505), ("10:30:30", 10 + 30.5 / 60), ("-1:30", -1.5), ("+0:00:36.00", 0.01), ("x 1:00:00.5 y", 1 + 0.5 / 3600), ("", None), ("12.5", None)):
        assert one(spark, text.parse_sexagesimal(F.lit(s))) == (None if want is None else pytest.approx(want))
    f = text.format_sexagesimal
    assert one(spark, f(lit(10.505), 9), f(lit(-1.5), 3), f(lit(1.5), 6, zero=True), f(lit(0.99999999), 6), f(lit(1.505), 5)) == ("10:30:18.00", "-1:30", "01:30:00", "1:00:00", "1:30.3")
    assert one(spark, f(lit(1.25), 8, plus=True, units=("°", "'", '"'))) == "+1°15'00.0\""


def test_names(spark):
    assert one(spark, text.name_tokens(F.lit("Test-1aaaa42 2 3"))) == ["test", "1", "aaaa", "42", "2", "3"]
    assert one(spark, text.exposure_text(lit(2.5)), text.exposure_text(lit(0.5)), text.temperature_text(lit(-10.4)), text.flags_text(F.lit(21))) == ("2s", "500ms", "-10C", "DPS")
    assert one(spark, text.duration_text(lit(3900)), text.duration_text(lit(0)), text.duration_text(lit(7265.9)), text.duration_text(lit(66)), text.duration_text(lit(45.9))) == ("1 h. 5 min.", "0 sec.", "2 h. 1 min.", "1 min.", "45 sec.")
    assert one(spark, text.duration_text(lit(7200), True), text.duration_text(lit(66), True), text.duration_text(lit(4), True)) == ("2h0m", "1m", "4s")
    assert one(spark, text.temperature_text(lit(-0.4)), text.temperature_text(lit(0)), text.temperature_text(lit(2.5))) == ("-0C", "+0C", "+2C")


def test_epochs(spark):
    # a century moves the pole by about 2004 seconds of arc, and a place on the equator by about 1.28 degrees
    ra, dec = one(spark, *epochs.convert(lit(0), lit(math.pi / 2), 0.0, 1.0))
    assert math.pi / 2 - dec == pytest.approx(math.radians(2004 / 3600), rel=0.02)
    ra, dec = one(spark, *epochs.convert(lit(1), lit(0), 0.0, 1.0))
    assert math.degrees(ra - 1) == pytest.approx(1.28, abs=0.02)
    m = epochs.precession(0.0, 0.5)
    assert abs(m @ m.T - [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).max() < 1e-12
    assert abs(epochs.precession(0.5, 0.0) @ m - [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).max() < 1e-6


def test_display(spark):
    s = [F.lit(float(x)) for x in (0, 0, 2, 2)]
    assert one(spark, *display.crossing(s, [F.lit(float(x)) for x in (0, 2, 2, 0)])) == (1, 1)
    assert one(spark, *display.crossing(s, [F.lit(float(x)) for x in (2, 2, 3, 0)])) == (2, 2)
    assert one(spark, *display.crossing(s, [F.lit(float(x)) for x in (0, 1, 2, 3)])) == (None, None)
    assert one(spark, display.smooth_both_ways(F.array(*[F.lit(x) for x in (10, 10, 10)]), 0.5)) == [10, 10, 10]
    assert one(spark, *display.star_colour(lit(9))) == (1.0, 0.4, 0.4)
    e = one(spark, display.ellipse(lit(1), lit(0.5), lit(0.02), lit(0.01), lit(0)))
    far = [math.hypot((p["ra"] - 1) * math.cos(0.5), p["dec"] - 0.5) for p in e]
    assert len(e) == 66 and max(far) == pytest.approx(0.01, rel=0.02) and min(far) == pytest.approx(0.005, rel=0.02)
    axis = [0.8, 0.1, math.sqrt(1 - 0.65)]
    import numpy as np

    axis = np.array(axis)
    side = np.cross(axis, [0, 1, 0])
    side /= np.linalg.norm(side)
    turned = [0.9 * axis + 0.4 * (math.cos(a) * side + math.sin(a) * np.cross(axis, side)) for a in (0, 0.5, 1.0)]
    alt, az = one(spark, *display.mount_pole(*[[lit(c) for c in p] for p in turned], lit(0.7)))
    assert alt == pytest.approx(math.asin(0.8) - 0.7) and az == pytest.approx(math.atan2(0.1, axis[2]))


def test_number_forms(spark):
    forms = [(3.14159, "%5.2f", " 3.14"), (-2.0, "%.0f", "-2"), (1234.5, "%3.1F", "1234.5"), (100.0, "%g", "100"), (0.00012, "%8.3g", "0.00012"), (59.9999, "%010.6m", "60:00:00"), (-5.5, "%9.6m", "-5:30:00"), (5.5, "%.3m", "5:30"), (5.5, "%05.5m", "05:30.0"), (2.25, "%3.4m", "2.25"), (2.25, "x", "2.2500000")]
    for value, form, want in forms:
        assert one(spark, text.number_text(lit(value), F.lit(form))) == want, form


def test_master_names(spark):
    import datetime

    of = lambda kind, temp, binning=1, exposure=2.0: (F.lit(kind), lit(exposure), F.lit(10), F.lit(5), F.lit(100), F.lit(80), F.lit(binning), lit(temp) if temp is not None else F.lit(None).cast("double"), F.lit(datetime.date(2024, 3, 9)))
    assert one(spark, text.master_name(*of("bias", -10.0, 2)), text.master_name(*of("flat", None)), text.master_name(*of("dark", 0.0, 1, 0.25))) == ("bias_g10_offs5_100x80_bin2x2_-10C.fit", "flat_2s_g10_offs5_100x80_2024-03-09.fit", "dark_250ms_g10_offs5_100x80_+0C.fit")
    assert one(spark, text.raw_folder(*of("dark", -5.0)), text.defect_name(F.lit(100), F.lit(80), F.lit(4))) == ("dark_2024-03-09__2s_g10_offs5_100x80_-5C", "defect_pixels_100x80_bin4x4.txt")


def test_compare(spark):
    nan = float("nan")
    assert [one(spark, numeric.compare(lit(a), lit(b))) for a, b in ((1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (nan, 1.0), (1.0, nan), (nan, nan))] == [-1, 1, 0, 0, 0, 0]


def test_descent_computes_each_value_once(spark):
    """The function stands in the plan once for the start and once for each way, not anew wherever its value is used."""
    from stardeck.functions import camera

    f = lambda p: (p[0] - F.col("a")) ** 2 + F.abs(p[1] - F.col("b") * 7919)
    d = spark.createDataFrame([(0.6, 0.0), (-9.0, 1 / 7919), (0.0, 0.0)], "a double, b double").repartition(2)
    out = d.select("a", camera.descend(F.array(F.lit(0.0), F.lit(0.0)), 0.25, 12, f).alias("p"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("7919") <= 5
    assert {r["a"]: r["p"] for r in out.collect()} == {0.6: [0.5, 0.0], -9.0: [-3.0, 1.0], 0.0: [0.0, 0.0]}
