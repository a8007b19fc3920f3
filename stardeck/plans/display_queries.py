"""Queries over what a sky map shows, solver output, file names and saves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as dp
from ..operators.spans import running
from .frame_queries import PIX, rows
from .registry import query, table

_KIND = "CASE p_size % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'cl+n' WHEN 2 THEN 'neb' WHEN 3 THEN '*Ass' ELSE 'what' END"


@query(f"""WITH k AS (SELECT p_partkey, {_KIND} AS code, CAST(p_partkey % 32 AS INT) AS flags FROM part)
  SELECT p_partkey, CASE code WHEN 'G' THEN 'galaxy' WHEN 'cl+n' THEN 'cluster with nebula' WHEN 'neb' THEN 'nebula' WHEN '*Ass' THEN 'association of stars' END AS kind,
    (flags & 2) <> 0 AND CASE code WHEN 'G' THEN (flags & 4) <> 0 WHEN 'cl+n' THEN (flags & 24) <> 0 WHEN 'neb' THEN (flags & 16) <> 0 WHEN '*Ass' THEN (flags & 8) <> 0 ELSE false END AS shown FROM k""")
def object_visibility(spark, sf_dir):
    k = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_KIND} AS code", "cast(p_partkey % 32 as int) AS flags")
    k = k.withColumn("kind", dp.object_type(F.col("code")))
    return k.select("p_partkey", "kind", dp.shown(F.col("kind"), F.col("flags")).alias("shown"))


@query("""WITH b AS (SELECT c_custkey, round(c_acctbal / 3000e0 - 0.5, 3) AS bv FROM customer)
  SELECT c_custkey, round(CASE WHEN bv <= -0.3 THEN 0.4 WHEN bv <= 0 THEN 0.4 + (bv + 0.3) * (0.5e0 / 0.3e0) WHEN bv <= 0.65 THEN 0.9 + bv * (0.1e0 / 0.65e0) ELSE 1.0 END, 6) AS red,
    round(CASE WHEN bv <= -0.3 THEN 0.66 WHEN bv <= 0 THEN 0.66 + (bv + 0.3) * (0.24e0 / 0.3e0) WHEN bv <= 0.65 THEN 0.9 + bv * (0.1e0 / 0.65e0) WHEN bv <= 1.6 THEN 1 - (bv - 0.65) * (0.1e0 / 0.95e0) WHEN bv <= 2.5 THEN 0.9 - (bv - 1.6) * (0.5e0 / 0.9e0) ELSE 0.4 END, 6) AS green,
    round(CASE WHEN bv <= -0.3 THEN 1 WHEN bv <= 0 THEN 1 - (bv + 0.3) * (0.1e0 / 0.3e0) WHEN bv <= 0.65 THEN 0.9 - bv * (0.2e0 / 0.65e0) WHEN bv <= 1.6 THEN 0.7 - (bv - 0.65) * (0.1e0 / 0.95e0) WHEN bv <= 2.5 THEN 0.6 - (bv - 1.6) * (0.2e0 / 0.9e0) ELSE 0.4 END, 6) AS blue FROM b""")
def star_colour(spark, sf_dir):
    b = table(spark, sf_dir, "customer").selectExpr("c_custkey", "round(c_acctbal / 3000e0 - 0.5, 3) AS bv")
    return b.select("c_custkey", *[F.round(c, 6).alias(n) for c, n in zip(dp.star_colour(F.col("bv")), ("red", "green", "blue"), strict=True)])


_OUT = "'Field center: (RA,Dec) = (' || n_nationkey || '.5, -' || n_nationkey || ') deg.' || chr(10) || 'Field size: 2.5 x 1.' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' degrees' ELSE ' arcminutes' END"


@query("""SELECT n_nationkey, round(radians(n_nationkey + 0.5), 9) AS ra, round(radians(-n_nationkey), 9) AS dec,
  round(radians(CAST('1.' || n_nationkey AS DOUBLE)) / CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 60 END, 9) AS height FROM nation""")
def solver_field(spark, sf_dir):
    f = dp.solver_field(F.expr(_OUT))
    return table(spark, sf_dir, "nation").select("n_nationkey", *[F.round(f[k], 9).alias(k) for k in ("ra", "dec", "height")])


@query("""SELECT event_id, 'Light_' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR), 4, '0') AS name FROM events""")
def sequential_names(spark, sf_dir):
    n = running(table(spark, sf_dir, "events"), "ts", ("event_id",), "user_id", {"n": F.lit(1).cast("long")})
    return n.select("event_id", F.concat(F.lit("Light_"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("name"))


@query("""WITH r AS (SELECT user_id, event_id, ts, sum(value) OVER w AS total, sum(value) OVER w - value AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT user_id, event_id FROM r WHERE floor(round(total, 6) / 300) > floor(round(before, 6) / 300)""")
def periodic_saves(spark, sf_dir):
    """Shots after which a result is saved: each time 300 more seconds of exposure have come together."""
    r = running(table(spark, sf_dir, "events"), "ts", ("event_id",), "user_id", {"total": F.col("value")})
    part = lambda c: F.floor(F.round(c, 6) / 300)
    return r.where(part(F.col("total")) > part(F.col("total") - F.col("value"))).select("user_id", "event_id")


@query("""WITH f AS (SELECT l_linenumber AS n, CAST(l_quantity * 1000 AS INT) AS median, l_extendedprice / 1000e0 AS e FROM lineitem)
  SELECT n, median, round(CASE WHEN median > 13207 AND median < 19760 THEN e WHEN median > 52428 THEN e / 2.5 WHEN median - 100 < 13107 THEN e * 2.5 WHEN median < 13207 THEN e * 1.4 ELSE e / 1.4 END, 6) AS exposure FROM f""")
def flat_exposure(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber AS n", "cast(l_quantity * 1000 as int) AS median", "l_extendedprice / 1000e0 AS e")
    return f.select("n", "median", F.round(dp.next_flat_exposure(F.col("e"), F.col("median"), F.lit(100)), 6).alias("exposure"))


@query("""WITH m AS (SELECT c_custkey, c_acctbal / 1000e0 AS mag FROM customer), d AS (SELECT *, greatest(0.7e0 * (pow(2e0, 0.4e0 * (8 - mag)) - 1), 1e0) AS d FROM m),
  b AS (SELECT *, CASE WHEN mag < 1 THEN greatest(d, 6e0) ELSE d END AS e FROM d)
  SELECT c_custkey, round(least(CASE WHEN e > 5 THEN 5 + (e - 5) / 2 ELSE e END, 9e0), 6) AS diameter FROM b""")
def star_sizes(spark, sf_dir):
    d = dp.star_diameter(F.col("c_acctbal") / 1000.0, F.lit(8.0), 0.7, 6.0, 5.0, 9.0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(d, 6).alias("diameter"))


@query("""SELECT p_partkey, round((log10(p_size) - log10(0.5e0)) * (16 / (log10(200e0) - log10(0.5e0))) + 4, 6) AS faintest, round(0.5e0 * (1000 + p_size) * 3.76e0 / 1000 / tan(radians(p_size / 20e0) / 2), 4) AS focal FROM part""")
def zoom_and_focal_length(spark, sf_dir):
    s = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(dp.faintest(s, 0.5, 200.0), 6).alias("faintest"), F.round(dp.focal_length(F.lit(3.76), 1000 + s, F.radians(s / 20)), 4).alias("focal"))


@query("""WITH s AS (SELECT c_custkey, c_custkey % 11 AS x1, c_custkey % 7 AS y1, c_custkey % 13 AS x2, c_custkey % 5 + 4 AS y2, c_custkey % 3 AS u1, c_custkey % 9 AS v1, c_custkey % 8 + 3 AS u2, c_custkey % 4 AS v2 FROM customer),
  d AS (SELECT *, (x2 - x1) * (v1 - v2) - (y2 - y1) * (u1 - u2) AS det FROM s),
  p AS (SELECT *, ((u1 - x1) * (v1 - v2) - (v1 - y1) * (u1 - u2)) / nullif(det, 0)::DOUBLE AS t, ((x2 - x1) * (v1 - y1) - (y2 - y1) * (u1 - x1)) / nullif(det, 0)::DOUBLE AS u FROM d)
  SELECT c_custkey, CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN round(x1 + (x2 - x1) * t, 6) END AS x, CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN round(y1 + (y2 - y1) * t, 6) END AS y FROM p""")
def segment_crossing(spark, sf_dir):
    k = F.col("c_custkey").cast("double")
    x, y = dp.crossing([k % 11, k % 7, k % 13, k % 5 + 4], [k % 3, k % 9, k % 8 + 3, k % 4])
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("WITH RECURSIVE " + PIX.removeprefix("WITH ") + """, p AS (SELECT frame, y, x, v, 63 - x AS b FROM pix),
  f AS (SELECT frame, y, 0 AS i, v::DOUBLE AS s FROM p WHERE x = 0 UNION ALL SELECT f.frame, f.y, f.i + 1, 0.25e0 * p.v + 0.75e0 * f.s FROM f JOIN p ON p.frame = f.frame AND p.y = f.y AND p.x = f.i + 1),
  g AS (SELECT frame, y, 0 AS i, v::DOUBLE AS s FROM p WHERE b = 0 UNION ALL SELECT g.frame, g.y, g.i + 1, 0.25e0 * p.v + 0.75e0 * g.s FROM g JOIN p ON p.frame = g.frame AND p.y = g.y AND p.b = g.i + 1)
  SELECT f.frame, f.y, f.i AS x, CAST(floor((least(floor(f.s), 65535) + least(floor(g.s), 65535)) / 2) AS INT) AS v FROM f JOIN g ON g.frame = f.frame AND g.y = f.y AND g.i = 63 - f.i""")
def smoothed_rows(spark, sf_dir):
    smooth = dp.smooth_both_ways(F.col("row"), 0.75)
    return rows(spark, sf_dir).select("frame", "y", smooth.alias("row")).select("frame", "y", F.posexplode("row").alias("x", "v"))


_TRIANGLE = "[(c_custkey % 97 - 20, c_custkey % 61 - 15), (c_custkey * 7 % 131 - 30, c_custkey * 3 % 89 - 20), (c_custkey * 11 % 71 - 10, c_custkey * 5 % 103 - 40)]"


@query(f"""WITH t AS (SELECT c_custkey, unnest({_TRIANGLE}) AS p, unnest([1, 2, 3]) AS i FROM customer), c AS (SELECT c_custkey, i, p[1]::DOUBLE AS x, p[2]::DOUBLE AS y, (c_custkey + i) % 5 < 2 AS seen FROM t),
  e AS (SELECT a.c_custkey, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy FROM c a JOIN c b ON a.c_custkey = b.c_custkey AND b.i = a.i % 3 + 1),
  s(u1, v1, du, dv) AS (VALUES (0e0, 0e0, 40e0, 0e0), (0e0, 30e0, 40e0, 0e0), (0e0, 0e0, 0e0, 30e0), (40e0, 0e0, 0e0, 30e0)),
  m AS (SELECT c_custkey, bool_or(dx * dv <> dy * du AND ((u1 - x1) * dv - (v1 - y1) * du) / nullif(dx * dv - dy * du, 0) BETWEEN 0 AND 1 AND ((u1 - x1) * dy - (v1 - y1) * dx) / nullif(dx * dv - dy * du, 0) BETWEEN 0 AND 1) AS met FROM e, s GROUP BY c_custkey),
  i AS (SELECT c_custkey, bool_or(x > 0 AND x < 40 AND y > 0 AND y < 30) AS inside, bool_or(seen) AS seen FROM c GROUP BY c_custkey)
  SELECT c_custkey, seen AND (inside OR coalesce(met, false)) AS shown FROM i JOIN m USING (c_custkey)""")
def items_in_view(spark, sf_dir):
    k = F.col("c_custkey")
    at = [(k % 97 - 20, k % 61 - 15), (k * 7 % 131 - 30, k * 3 % 89 - 20), (k * 11 % 71 - 10, k * 5 % 103 - 40)]
    points = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), ((k + i + 1) % 5 < 2).alias("seen")) for i, (x, y) in enumerate(at)])
    return table(spark, sf_dir, "customer").select("c_custkey", dp.in_view(points, 0.0, 0.0, 40.0, 30.0).alias("shown"))


_QUAD = [(5, 3), (71, 8), (62, 55), (2, 46)]


def _quad_sql() -> str:
    """Places in the unit square from the closed form of the map's inverse, in SQL."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = _QUAD
    det = (x1 - x2) * (y3 - y2) - (y1 - y2) * (x3 - x2)
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    g, h = f"({sx * (y3 - y2) - sy * (x3 - x2)}e0 / {det}e0)", f"({(x1 - x2) * sy - (y1 - y2) * sx}e0 / {det}e0)"
    a, b, c = f"({x1 - x0} + {g} * {x1})", f"({x3 - x0} + {h} * {x3})", f"{x0}e0"
    d, e, f = f"({y1 - y0} + {g} * {y1})", f"({y3 - y0} + {h} * {y3})", f"{y0}e0"
    return f"""n AS (SELECT x, y, ({e} - {f} * {h}) * x + ({c} * {h} - {b}) * y + ({b} * {f} - {c} * {e}) AS u, ({f} * {g} - {d}) * x + ({a} - {c} * {g}) * y + ({c} * {d} - {a} * {f}) AS v,
      ({d} * {h} - {e} * {g}) * x + ({b} * {g} - {a} * {h}) * y + ({a} * {e} - {b} * {d}) AS w FROM (SELECT unnest(range(2, 72)) AS x) CROSS JOIN (SELECT unnest(range(3, 56)) AS y)),
    k AS (SELECT CAST(y AS INT) AS ty, CAST(x AS INT) AS tx, CAST(trunc(round(64 * u / w, 9)) AS INT) AS x, CAST(trunc(round(50 * v / w, 9)) AS INT) AS y FROM n)"""


@query(PIX + f", {_quad_sql()} SELECT frame, ty AS y, tx AS x, v FROM k JOIN pix USING (y, x)")
def perspective_warp(spark, sf_dir):
    from ..operators.stacking import onto_quad

    return onto_quad(rows(spark, sf_dir), _QUAD, 64, 50)
