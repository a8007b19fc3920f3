"""Queries over catalogue and device texts, guider messages and plain formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, sky
from ..operators import sessions as se
from ..sources import tables
from ..streaming import shots as stream
from .registry import query, table
from .sky_queries import SHOTS, shots


@query("""WITH c AS (SELECT c_custkey, c_acctbal / 10000e0 * 1.5 AS a, c_acctbal / 4000e0 AS w FROM customer)
  SELECT c_custkey, round(radians(57.085e0 / 3600) * tan(pi() / 2 - greatest(a, radians(3))) - radians(0.0666e0 / 3600) * tan(pi() / 2 - greatest(a, radians(3))), 9) AS refraction,
    round(CASE WHEN w < -pi() THEN w + 2 * pi() WHEN w > pi() THEN w - 2 * pi() ELSE w END, 9) AS wrapped, round((w - 1) * ((7e0 - 3) / (4e0 - 1)) + 3, 9) AS between FROM c""")
def angle_forms(spark, sf_dir):
    a, w = F.col("c_acctbal") / 10000.0 * 1.5, F.col("c_acctbal") / 4000.0
    forms = [sky.refraction(a).alias("refraction"), numeric.wrap(w).alias("wrapped"), numeric.interpolate(w, 1.0, 4.0, 3.0, 7.0).alias("between")]
    return table(spark, sf_dir, "customer").select("c_custkey", *forms).select("c_custkey", *[F.round(c, 9).alias(c) for c in ("refraction", "wrapped", "between")])


@query("""WITH v AS (SELECT c_custkey, cos(d) * cos(r) AS x, cos(d) * sin(r) AS y, sin(d) AS z FROM (SELECT c_custkey, c_custkey * 0.37e0 AS r, asin(((c_custkey * 7) % 200 - 100) / 100e0) AS d FROM customer))
  SELECT c_custkey, CASE WHEN z > -0.999999 THEN round(100 * 2 * y / (1 + z), 6) END AS px, CASE WHEN z > -0.999999 THEN round(100 * 2 * x / (1 + z), 6) END AS py FROM v""")
def stereographic(spark, sf_dir):
    k = F.col("c_custkey")
    v = sky.to_vector(k * 0.37, F.asin(((k * 7) % 200 - 100) / 100.0))
    x, y = sky.stereographic(*v, 100.0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("""WITH m AS (SELECT p_partkey, p_size AS a, p_partkey % 7 AS b, 2 AS c, p_partkey % 5 AS d, p_size % 9 AS e, 1 AS f, 3 AS g, p_partkey % 4 AS h, p_size % 6 AS i, p_partkey % 11 AS r, p_size % 13 AS s, 5 AS t FROM part),
  d AS (SELECT *, (a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))::DOUBLE AS det FROM m)
  SELECT p_partkey, CAST(floor((r * (e * i - f * h) - b * (s * i - f * t) + c * (s * h - e * t)) / nullif(det, 0) * 1000000 + 0.3e0) AS BIGINT) AS x, CAST(floor((a * (s * i - f * t) - r * (d * i - f * g) + c * (d * t - s * g)) / nullif(det, 0) * 1000000 + 0.3e0) AS BIGINT) AS y,
    CAST(floor((a * (e * t - s * h) - b * (d * t - s * g) + r * (d * h - e * g)) / nullif(det, 0) * 1000000 + 0.3e0) AS BIGINT) AS z FROM d""")
def linear_systems(spark, sf_dir):
    """Solutions in millionths."""
    k, s, n = F.col("p_partkey"), F.col("p_size"), lambda x: F.lit(x)
    m = [[s, k % 7, n(2)], [k % 5, s % 9, n(1)], [n(3), k % 4, s % 6]]
    x, y, z = numeric.solve3(m, [k % 11, s % 13, n(5)])
    return table(spark, sf_dir, "part").select("p_partkey", *[F.floor(c * 1000000 + 0.3).alias(name) for c, name in ((x, "x"), (y, "y"), (z, "z"))])


_MINORS = [[f"({a} * {d} - {b} * {c})" for a, b, c, d in row] for row in (
    [("m22", "m23", "m32", "m33"), ("m13", "m12", "m33", "m32"), ("m12", "m13", "m22", "m23")],
    [("m23", "m21", "m33", "m31"), ("m11", "m13", "m31", "m33"), ("m13", "m11", "m23", "m21")],
    [("m21", "m22", "m31", "m32"), ("m12", "m11", "m32", "m31"), ("m11", "m12", "m21", "m22")],
)]
_MATRIX = ["p_size", "p_partkey % 7", "2", "p_partkey % 5", "p_size % 9", "1", "3", "p_partkey % 4", "p_size % 6"]
_CELLS = [f"m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


@query(f"""WITH m AS (SELECT p_partkey, {', '.join(f'({e})::DOUBLE AS {c}' for e, c in zip(_MATRIX, _CELLS, strict=True))} FROM part),
  d AS (SELECT *, m11 * {_MINORS[0][0]} + m12 * {_MINORS[1][0]} + m13 * {_MINORS[2][0]} AS det FROM m)
  SELECT p_partkey, {', '.join(f"round({_MINORS[i][j]} / nullif(det, 0), 9) + 0 AS {_CELLS[3 * i + j]}" for i in range(3) for j in range(3))} FROM d""")
def matrix_inverse(spark, sf_dir):
    m = [[F.expr(f"cast({_MATRIX[3 * i + j]} as double)") for j in range(3)] for i in range(3)]
    inverse = [c for row in numeric.inverse3(m) for c in row]
    return table(spark, sf_dir, "part").select("p_partkey", *[(F.round(c, 9) + 0.0).alias(n) for c, n in zip(inverse, _CELLS, strict=True)])


@query("""WITH p AS (SELECT s_suppkey, s_suppkey % 5 - 2e0 AS a, s_suppkey % 7 - 3e0 AS b, s_suppkey % 3 - 1e0 AS c, s_suppkey % 11 - 4e0 AS d FROM supplier),
  l AS (SELECT s_suppkey, -a / nullif(c, 0) AS slope, (-b * 2 - d) / nullif(c, 0) AS level FROM p),
  m AS (SELECT *, (1.5e0 - level) / nullif(slope - 0.25e0, 0) AS x FROM l)
  SELECT s_suppkey, round(slope, 9) + 0 AS slope, round(level, 9) + 0 AS level, round(x, 9) + 0 AS x, round(slope * x + level, 9) + 0 AS z FROM m""")
def plane_cuts(spark, sf_dir):
    """The lines in which planes meet that of y = 2, and where those meet the line z = x / 4 + 1.5."""
    a, b, c, d = (F.expr(f"s_suppkey % {n} - {k}e0") for n, k in ((5, 2), (7, 3), (3, 1), (11, 4)))
    slope, at = numeric.plane_cut(a, b, c, d, F.lit(2.0))
    x, z = numeric.lines_meet(slope, at, F.lit(0.25), F.lit(1.5))
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[(F.round(v, 9) + 0.0).alias(n) for v, n in ((slope, "slope"), (at, "level"), (x, "x"), (z, "z"))])


_LINE = """CASE event_id % 8 WHEN 0 THEN '{"Event":"GuideStep","Timestamp":' || event_id || '.5,"dx":' || value || '}' WHEN 1 THEN '{"Event":"SettleDone","Timestamp":1,"Status":' || event_id % 2 || ',"Error":"late"}'
    WHEN 2 THEN '{"Event":"AppState","State":"Looping"}' WHEN 3 THEN '{"jsonrpc":"2.0","error":{"code":1,"message":"no star"},"id":' || event_id || '}' WHEN 4 THEN '{"Event":"Paused"}' WHEN 5 THEN '{"jsonrpc":"2.0","result":0,"id":7}'
    WHEN 6 THEN '{"Event":"SettleDone","Status":0}' ELSE 'no message' END"""


@query("""SELECT event_id, CASE WHEN k = 0 THEN event_id + 0.5e0 WHEN k = 1 THEN 1e0 END AS timestamp, CASE k WHEN 0 THEN 'GuideStep' WHEN 1 THEN 'SettleDone' WHEN 2 THEN 'AppState' WHEN 4 THEN 'Paused' WHEN 6 THEN 'SettleDone' END AS event,
    CASE k WHEN 0 THEN 'Guiding' WHEN 2 THEN 'Looping' WHEN 4 THEN 'Paused' END AS state, CASE WHEN k = 6 OR (k = 1 AND event_id % 2 = 0) THEN 'DitheringFinished' WHEN k = 1 THEN 'DitheringFailed' WHEN k = 3 THEN 'Error' END AS outcome,
    CASE k WHEN 1 THEN 'late' WHEN 3 THEN 'no star' END AS message FROM (SELECT event_id, event_id % 8 AS k FROM events) WHERE k <> 7""")
def guider_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_LINE} AS value")
    return stream.guider_events(e, keep=("event_id",)).select("event_id", "timestamp", "event", "state", "outcome", "message")


@query("""WITH g AS (SELECT event_id, event_id % 37 / 10e0 AS dx, event_id % 23 / 10e0 AS dy FROM events), d AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM g),
  k AS (SELECT *, CASE WHEN d <= 1.5 THEN 0 WHEN d < 3 THEN 0.5 ELSE 1 END AS k FROM d) SELECT event_id, round(dx * k, 6) AS mx, round(dy * k, 6) AS my FROM k""")
def guide_corrections(spark, sf_dir):
    g = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 37 / 10e0 AS dx", "event_id % 23 / 10e0 AS dy")
    x, y = stream.guide_correction(F.hypot("dx", "dy"), F.col("dx"), F.col("dy"), 1.5)
    return g.select("event_id", F.round(x, 6).alias("mx"), F.round(y, 6).alias("my"))


@query("SELECT event_id, event_type || ' ' || event_id AS text FROM events")
def base64_text(spark, sf_dir):
    """Text through base64 with characters strewn in that are not of the alphabet."""
    b = F.regexp_replace(F.base64(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))), "(.{5})", "$1\n-")
    return table(spark, sf_dir, "events").select("event_id", tables.decode_base64(b).cast("string").alias("text"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 24 AS h, p_partkey % 60 AS m, p_partkey % 90 AS d FROM part)
  SELECT p_partkey, round(radians(15e0 * (h + m / 60e0 + p_size / 3600e0)), 9) AS ra, round(radians(-(d + m / 60e0)), 9) AS dec, 'M' || p_partkey || '|' || 'ngc' || p_size AS names, 'm,' || p_partkey AS parts, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS nicknames, p_size / 10e0 AS mag
  FROM p WHERE p_partkey % 10 > 0""")
def dso_catalogue(spark, sf_dir):
    """Objects from the text columns of a catalogue file; rows without a right ascension are left out."""
    raw = table(spark, sf_dir, "part").selectExpr(
        "'g' AS type", "CASE WHEN p_partkey % 10 > 0 THEN concat(p_partkey % 24, ':', lpad(p_partkey % 60, 2, '0'), ':', lpad(p_size, 2, '0')) END AS ra", "concat('-', p_partkey % 90, ':', lpad(p_partkey % 60, 2, '0')) AS dec", "'And' AS constellation",
        "concat(' M', p_partkey, ' |NGC', p_size, '||') AS names", "CASE WHEN p_size % 2 = 0 THEN 'The Nick' END AS nicknames", "cast(p_size / 10e0 as string) AS mag_v", "'' AS mag_b", "'1' AS major_axis", "'x' AS minor_axis", "'0' AS angle",
    )
    d = tables.dsos_of(raw)
    names = F.concat_ws("|", F.col("names")[0]["orig"], F.col("names")[1]["lc"])
    key = F.regexp_extract(F.col("names")[0]["orig"], r"(\d+)", 1).cast("long")
    return d.select(key.alias("p_partkey"), F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"), names.alias("names"), F.array_join(F.col("names")[0]["parts"], ",").alias("parts"), F.size("nicknames").alias("nicknames"), F.col("mag_v").alias("mag"))


@query("""SELECT s_suppkey, lower(s_name) AS name_lc, 'alp ' || s_suppkey AS bayer_lc, round(radians(15e0 * (s_suppkey % 24 + 0.5e0)), 9) AS ra, CASE WHEN s_suppkey % 2 = 0 THEN 0e0 ELSE 0.5e0 END AS bv FROM supplier""")
def named_star_catalogue(spark, sf_dir):
    raw = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name AS name", "concat('Alp ', s_suppkey) AS bayer", "concat(s_suppkey % 24, ':30:00') AS ra", "'-5.5' AS dec", "'Ori' AS constellation", "cast(s_acctbal as string) AS mag", "CASE WHEN s_suppkey % 2 = 1 THEN '0.5' ELSE 'none' END AS bv")
    d = tables.named_stars_of(raw)
    return d.select(F.regexp_extract("bayer", r"(\d+)", 1).cast("long").alias("s_suppkey"), "name_lc", "bayer_lc", F.round("ra", 9).alias("ra"), "bv")


@query("""SELECT p_type AS "group", count(*) AS n, string_agg(lower(p_brand) || '/' || p_name, '|' ORDER BY lower(p_brand), lower(p_name), p_name, p_partkey) AS devices FROM part GROUP BY p_type""")
def device_groups(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_type AS group", "p_brand AS maker", "p_name AS label", "lpad(p_partkey, 12, '0') AS driver")
    g = tables.driver_groups(d)
    return g.select("group", F.size("devices").cast("long").alias("n"), F.array_join(F.transform("devices", lambda x: F.concat(x["by"], F.lit("/"), x["label"])), "|").alias("devices"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(value AS DOUBLE) ELSE 1.5e0 END AS gain, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'main' END AS name FROM events")
def settings_defaults(spark, sf_dir):
    """Settings that are read from JSON, with defaults for keys that are missing."""
    text = "concat('{\"event_id\":', event_id, CASE WHEN event_id % 2 = 0 THEN concat(',\"gain\":', value) ELSE '' END, CASE WHEN event_id % 3 = 0 THEN concat(',\"name\":\"', event_type, '\"') ELSE '' END, '}')"
    d = table(spark, sf_dir, "events").select(F.from_json(F.expr(text), "event_id long, gain double, name string").alias("s")).select("s.*")
    return tables.with_defaults(d, {"gain": 1.5, "name": "main"})


@query(SHOTS + " SELECT camera, arg_min(shot, (ts, shot)) AS shot FROM shots WHERE ok GROUP BY camera")
def first_good_shot(spark, sf_dir):
    return se.first_good(shots(spark, sf_dir))


@query(SHOTS + " SELECT camera, time_bucket(INTERVAL 10 MINUTES, ts) AS start, round(sum(exposure), 4) AS exposure, CAST(sum(ok::INT) AS BIGINT) AS good FROM shots GROUP BY ALL")
def exposure_windows(spark, sf_dir):
    w = stream.exposure_windows(shots(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select("camera", F.col("start").cast("timestamp_ntz").alias("start"), F.round("exposure", 4).alias("exposure"), "good")
