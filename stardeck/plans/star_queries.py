"""Queries over stars: detection on frames whose stars are the vectors of `embeddings`, triangles of catalogue points, planes and gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import registration as reg
from ..operators import stars as st
from ..operators.cuts import cut
from .frame_queries import PIX, H, W, rows
from .registry import query, table

SIZE, FIELD = 160, 25


def star_frames(spark, sf_dir) -> DataFrame:
    """Row blocks (frame, y, row) of SIZE x SIZE pixels: every 25 vectors are a frame, each vector a Gaussian star of sigma 1.

    The 25 places are the same sky in all frames, irregular enough that triangles differ. A frame is moved by up to 6 pixels each way, by its first vector.
    """
    v = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) > 2")
    v = v.selectExpr(f"vec_id div {FIELD} AS frame", f"vec_id % {FIELD} AS k", "cast(embedding AS array<double>) AS e")
    # few bytes make many pixels, so partitions are not to be merged by their size
    v = v.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame")
    move = "greatest(-6e0, least(6e0, 32 * min_by(e[{0}], k)))"
    stars = f"collect_list(struct({SIZE} div 5 * (k div 5) + 6e0 + (5 * k * k + 3 * k) % 19 AS x, {SIZE} div 5 * (k % 5) + 5e0 + (3 * k * k + 11 * k) % 23 AS y, 4500 + 80 * k + 1000 * e[2] AS a))"
    f = v.groupBy("frame").agg(F.expr(stars).alias("stars"), F.expr(move.format(0)).alias("dx"), F.expr(move.format(1)).alias("dy"))
    return f.select("frame", "stars", "dx", "dy", F.xxhash64("frame").alias("seed")).mapInArrow(_drawn, "frame long, y int, row array<int>")


def _hashed(n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int after what gave the seed."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (n.astype(np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row blocks of frames (frame, stars, dx, dy, seed); a pixel whose light is unknown is null."""
    n = np.arange(SIZE)
    for batch in batches:
        for frame, stars, dx, dy, seed in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            light = np.zeros((SIZE, SIZE))
            for s in stars:
                x, y = s["x"] + dx, s["y"] + dy
                rows, columns = (slice(max(int(c) - 6, 0), max(int(c) + 7, 0)) for c in (y, x))
                d = (n[None, columns] - s["x"] - dx) ** 2 + (n[rows, None] - s["y"] - dy) ** 2
                light[rows, columns] += np.where(d <= 18, (np.nan if s["a"] is None else s["a"]) * np.exp(-d / 2), 0.0)
            noise = _hashed(n[None, :], _hashed(n, np.array([seed]).view(np.uint64))[:, None]).view(np.int64) % 9
            value = light + 100 + noise
            flat = pa.array(np.nan_to_num(value).astype(np.int32).ravel(), mask=np.isnan(value).ravel())
            row = pa.ListArray.from_arrays(pa.array(np.arange(0, SIZE * SIZE + 1, SIZE), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array([frame] * SIZE, pa.int64()), pa.array(n, pa.int32()), row], ["frame", "y", "row"])


@query()
def star_metrics(spark, sf_dir):
    """Threshold, extrema, clusters, growth and profile of frames of stars, as one row a frame."""
    r = cut(star_frames(spark, sf_dir))
    t = st.detection_threshold(r)
    few, t = st.few_extrema(st.extrema(r, t, SIZE, SIZE), t)
    found = st.grow(r, st.clusters(few), t)
    m = st.measure(r, found)
    return m.select("frame", "stars", *[F.round(c, 4).alias(c) for c in ("hfd", "fwhm", "ovality")])


@query()
def frame_offset(spark, sf_dir):
    """Offsets of all frames of stars against the first."""
    r = cut(star_frames(spark, sf_dir))
    t = st.detection_threshold(r)
    few, t = st.few_extrema(st.extrema(r, t, SIZE, SIZE), t)
    found = cut(st.grow(r, st.clusters(few), t).select("frame", "x", "y", "brightness"))
    first = found.agg(F.min("frame")).first()[0]
    o = reg.offsets(found.where(F.col("frame") == F.lit(first)), found, SIZE, SIZE)
    return o.select("frame", *[F.round(c, 3).alias(c) for c in ("x", "y", "angle")])


_CHUNK = "list_sort([a[{p} + 1], a[{p} + 2], a[{p} + 3], a[{p} + 4], a[{p} + 5]])[3]"


@query(PIX + """, r AS (SELECT frame, y, list(v ORDER BY x) AS row FROM pix GROUP BY ALL),
  c AS (SELECT frame, row[(y & 15) + 32 * k + 1 : (y & 15) + 32 * k + 32] AS a FROM r, (VALUES (0), (1)) t(k) WHERE (y & 15) + 32 * k + 32 <= 64),
  d AS (SELECT frame, list_sort(a[1:5])[3] + list_sort(a[28:32])[3] - 2 * list_sort(a[16:18])[2] AS d FROM c),
  m AS (SELECT frame, list_sort(list(d::BIGINT * d))[count(*) // 2 + 1] AS m FROM d WHERE abs(d) <= 32767 GROUP BY frame)
  SELECT frame, CAST(greatest(1, least(65535, floor(7.5e0 * sqrt(m)))) AS INT) AS threshold FROM m""")
def star_threshold(spark, sf_dir):
    return st.detection_threshold(rows(spark, sf_dir))


_EXT = """, r AS (SELECT frame, y, list(v ORDER BY x) AS row FROM pix GROUP BY ALL),
  b AS (SELECT *, list_sort(row)[33] AS f FROM r WHERE y BETWEEN 16 AND 34),
  p AS (SELECT frame, y, CAST(x AS INT) AS x, f, list_sort(row[x : x + 2])[2] AS v,
      (list_sum(list_sort(row[x - 4 : x - 1])[2:3]) + 1) // 2 AS l, (list_sum(list_sort(row[x + 3 : x + 6])[2:3]) + 1) // 2 AS r FROM b, (SELECT unnest(range(16, 49)) AS x)),
  ext AS (SELECT frame, y, x, CAST(v AS INT) AS v FROM p WHERE v - f >= 1500 AND l < v AND r < v)"""


def _extrema(spark, sf_dir) -> DataFrame:
    r = rows(spark, sf_dir)
    return st.extrema(r, r.select("frame").distinct().withColumn("threshold", F.lit(1500)), W, H)


@query(PIX + _EXT + " SELECT frame, y, x, v FROM ext")
def extrema(spark, sf_dir):
    return _extrema(spark, sf_dir).drop("over")


_LEVELS = ["1500"]
for _ in range(4):
    _LEVELS.append(f"(3 * ({_LEVELS[-1]} + 1) // 2)")


@query(PIX + _EXT.replace("CAST(v AS INT) AS v FROM p", "CAST(v AS INT) AS v, CAST(v - f AS INT) AS over FROM p") + f""", l AS (SELECT k, t FROM (VALUES {', '.join(f'({k}, {t})' for k, t in enumerate(_LEVELS))}) x(k, t)),
  n AS (SELECT f.frame, k, t, count(e.frame) AS n FROM (SELECT DISTINCT frame FROM pix) f CROSS JOIN l LEFT JOIN ext e ON e.frame = f.frame AND e.over >= t GROUP BY ALL),
  c AS (SELECT frame, min(t) AS threshold FROM n WHERE n < 40 GROUP BY frame)
  SELECT e.frame, y, x, v, threshold FROM ext e JOIN c ON c.frame = e.frame AND over >= threshold""")
def extrema_escalated(spark, sf_dir):
    r = rows(spark, sf_dir)
    t = r.select("frame").distinct().withColumn("threshold", F.lit(1500))
    few, raised = st.few_extrema(st.extrema(r, t, W, H), t, 40)
    return few.join(raised, "frame").select("frame", "y", "x", "v", "threshold")


@query("WITH RECURSIVE " + PIX.removeprefix("WITH ") + _EXT + """,
  c AS (SELECT frame, y, x, v, y AS ty, x AS tx FROM ext UNION
    SELECT c.frame, c.y, c.x, c.v, e.y, e.x FROM c JOIN ext e ON e.frame = c.frame AND abs(e.y - c.ty) <= 1 AND abs(e.x - c.tx) <= 1),
  g AS (SELECT c.frame, c.y, c.x, c.v, min(c.ty * 1000 + c.tx) AS grp FROM c GROUP BY ALL)
  SELECT frame, y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY frame, grp ORDER BY v DESC, y, x) AS r FROM g) WHERE r = 1""")
def extrema_clusters(spark, sf_dir):
    return st.clusters(_extrema(spark, sf_dir))


#: Customers as star lists: 150 a frame, so frames grow in number; the 50 brightest make triangles, as in the first attempt at an offset.
POINTS = "SELECT c_custkey // 150 AS frame, CAST(c_custkey * 37 % 211 AS DOUBLE) AS x, CAST(c_custkey * 53 % 199 AS DOUBLE) AS y, c_acctbal AS brightness FROM customer"
BRIGHT, LEAST, ERROR = reg.ATTEMPTS[0][0], 41.0, reg.ATTEMPTS[0][1]


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey div 150 AS frame", "cast(c_custkey * 37 % 211 as double) AS x", "cast(c_custkey * 53 % 199 as double) AS y", "c_acctbal AS brightness")


_TRI = f"""WITH p AS (SELECT frame, x, y, row_number() OVER (PARTITION BY frame ORDER BY brightness DESC, x, y) AS i FROM ({POINTS})),
  t AS (SELECT a.frame, a.i, b.i AS j, c.i AS k, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS l1, sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)) AS l2, sqrt(pow(c.x - a.x, 2) + pow(c.y - a.y, 2)) AS l3
    FROM p a JOIN p b ON a.frame = b.frame AND a.i < b.i JOIN p c ON a.frame = c.frame AND b.i < c.i WHERE c.i <= {BRIGHT}),
  s AS (SELECT frame, CASE WHEN l1 <= l2 AND l1 <= l3 THEN i WHEN l2 <= l3 THEN j ELSE k END AS i, CASE WHEN l1 <= l2 AND l1 <= l3 THEN l1 WHEN l2 <= l3 THEN l2 ELSE l3 END AS a,
    CASE WHEN l1 <= l2 AND l1 <= l3 THEN l2 WHEN l2 <= l3 THEN l3 ELSE l1 END AS b, CASE WHEN l1 <= l2 AND l1 <= l3 THEN l3 WHEN l2 <= l3 THEN l1 ELSE l2 END AS c, l1 + l2 + l3 AS len FROM t WHERE l1 + l2 + l3 >= {LEAST})"""


@query(_TRI + " SELECT frame, i, count(*) AS triangles, round(sum(a), 3) AS a, round(sum(b), 3) AS b, round(sum(c), 3) AS c FROM s GROUP BY frame, i")
def star_triangles(spark, sf_dir):
    """All triangles of each frame's brightest stars, summed by the corner that their sides begin at."""
    t = reg.triangles(reg.brightest(points(spark, sf_dir), BRIGHT), LEAST)
    return t.groupBy("frame", "i").agg(F.count("*").alias("triangles"), *[F.round(F.sum(c), 3).alias(c) for c in "abc"])


@query(_TRI + f""", n AS (SELECT *, CAST(floor(len / {ERROR}) AS BIGINT) AS bin FROM s), r AS (SELECT *, bin + d AS near FROM n, (VALUES (-1), (0), (1)) t(d) WHERE frame = 0)
  SELECT o.frame, r.i AS ri, count(*) AS pairs, round(sum(o.len), 3) AS len, round(sum(r.len), 3) AS rlen FROM n o JOIN r ON o.bin = r.near
  WHERE o.frame > 0 AND o.len >= r.len - {ERROR} AND o.len < r.len + {ERROR} AND pow(o.a - r.a, 2) + pow(o.b - r.b, 2) + pow(o.c - r.c, 2) < {ERROR} * {ERROR} GROUP BY o.frame, r.i""")
def triangle_match(spark, sf_dir):
    """Every frame's triangles that are similar to those of the first frame, counted by the corner in that."""
    t = reg.triangles(reg.brightest(points(spark, sf_dir), BRIGHT), LEAST)
    m = reg.matches(t.where("frame = 0"), t.where("frame > 0"), ERROR)
    return m.groupBy("frame", "ri").agg(F.count("*").alias("pairs"), F.round(F.sum("len"), 3).alias("len"), F.round(F.sum("rlen"), 3).alias("rlen"))


@query("""WITH z AS (SELECT s_nationkey AS g, CAST(s_suppkey % 17 AS DOUBLE) AS x, CAST(s_suppkey % 23 AS DOUBLE) AS y, s_acctbal / 100e0 AS z FROM supplier),
  q AS (SELECT g % 2 AS g, sum(x*x) xx, sum(x*y) xy, sum(y*y) yy, sum(x) sx, sum(y) sy, count(*)::DOUBLE n, -sum(x*z) xz, -sum(y*z) yz, -sum(z) sz FROM z GROUP BY g % 2),
  d AS (SELECT *, xx*(yy*n - sy*sy) - xy*(xy*n - sy*sx) + sx*(xy*sy - yy*sx) AS det FROM q)
  SELECT g, round((xz*(yy*n - sy*sy) - xy*(yz*n - sy*sz) + sx*(yz*sy - yy*sz)) / det, 6) AS a, round((xx*(yz*n - sy*sz) - xz*(xy*n - sy*sx) + sx*(xy*sz - yz*sx)) / det, 6) AS b,
    round((xx*(yy*sz - yz*sy) - xy*(xy*sz - yz*sx) + xz*(xy*sy - yy*sx)) / det, 6) AS d FROM d""")
def gradient_plane(spark, sf_dir):
    z = table(spark, sf_dir, "supplier").selectExpr("s_nationkey % 2 AS g", "cast(s_suppkey % 17 as double) AS x", "cast(s_suppkey % 23 as double) AS y", "s_acctbal / 100e0 AS z")
    a, b, d = numeric.plane_fit(F.col("x"), F.col("y"), F.col("z"))
    return z.groupBy("g").agg(F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(d, 6).alias("d"))


#: The pixels of gradient_frames() in the cells of the four corners.
_CELLS = """f AS (SELECT vec_id // 1000 AS frame, arg_min(embedding, vec_id) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 1 GROUP BY ALL),
  g AS (SELECT frame, 2e-1 + CAST(e[1] AS DOUBLE) / 4 AS gx, 1e-1 + CAST(e[2] AS DOUBLE) / 4 AS gy FROM f),
  l AS (SELECT x, y FROM (VALUES (13), (30), (47), (64), (81), (98), (115)) t(x), (VALUES (13)) u(y) UNION SELECT 13, y FROM (VALUES (30), (47), (64), (81), (98)) t(y)),
  corner AS (SELECT x, y FROM l UNION ALL SELECT 640 - x, y FROM l UNION ALL SELECT x, 512 - y FROM l UNION ALL SELECT 640 - x, 512 - y FROM l),
  near AS (SELECT frame, gx, gy, k.x AS cx, k.y AS cy, k.x + dx AS x, k.y + dy AS y FROM g, corner k, range(-8, 9) a(dx), range(-8, 9) b(dy)),
  n AS (SELECT frame, cx AS x, cy AS y, list_sort(list(CAST(500 + ((y * 640 + x) * 7919) % 11 + floor(x * gx + y * gy) AS INT))) AS a FROM near GROUP BY ALL),
  cell AS (SELECT frame, x, y, list_avg(a[len(a) // 3 + 1 : 2 * len(a) // 3]) AS z FROM n)"""


@query("WITH " + _CELLS + " SELECT frame, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(z, 6) AS z FROM cell")
def gradient_cells(spark, sf_dir):
    from ..operators import gradient

    return gradient.cells(gradient_frames(spark, sf_dir), 640, 512).select("frame", "x", "y", F.round("z", 6).alias("z"))


def gradient_frames(spark, sf_dir) -> DataFrame:
    """Pixels (frame, y, x, v) of 640 x 512: every 1,000 vectors are a frame, whose slopes come from its first vector."""
    v = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) > 1")
    f = v.groupBy(F.expr("vec_id div 1000").alias("frame")).agg(F.expr("min_by(embedding, vec_id)").alias("e"))
    f = f.select("frame", F.expr("2e-1 + cast(e[0] AS double) / 4").alias("gx"), F.expr("1e-1 + cast(e[1] AS double) / 4").alias("gy"), F.explode(F.expr("sequence(0, 511)")).alias("y"))
    f = f.repartition("frame", "y").select("*", F.explode(F.expr("sequence(0, 639)")).alias("x"))
    return f.selectExpr("frame", "y", "x", "cast(500 + ((y * 640L + x) * 7919) % 11 + floor(x * gx + y * gy) AS int) AS v")


@query("WITH " + _CELLS + """, m AS (SELECT frame, x, y, z - avg(z) OVER (PARTITION BY frame) AS z FROM cell),
  q AS (SELECT frame, sum(x*x)::DOUBLE xx, sum(x*y)::DOUBLE xy, sum(y*y)::DOUBLE yy, sum(x)::DOUBLE sx, sum(y)::DOUBLE sy, count(*)::DOUBLE n, -sum(x*z) xz, -sum(y*z) yz, -sum(z) sz FROM m GROUP BY frame),
  d AS (SELECT *, xx*(yy*n - sy*sy) - xy*(xy*n - sy*sx) + sx*(xy*sy - yy*sx) AS det FROM q),
  p AS (SELECT frame, (xz*(yy*n - sy*sy) - xy*(yz*n - sy*sz) + sx*(yz*sy - yy*sz)) / det AS a, (xx*(yz*n - sy*sz) - xz*(xy*n - sy*sx) + sx*(xy*sz - yz*sx)) / det AS b,
    (xx*(yy*sz - yz*sy) - xy*(xy*sz - yz*sx) + xz*(xy*sy - yy*sx)) / det AS d FROM d),
  e AS (SELECT *, greatest(-d, -(640*a + d), -(512*b + d), -(640*a + 512*b + d)) - least(-d, -(640*a + d), -(512*b + d), -(640*a + 512*b + d)) < 5 AS flat FROM p),
  r AS (SELECT frame, y, flat, CAST(round(-(b*y + d)) AS INT) AS z1, CAST(round(-(640*a + b*y + d)) AS INT) AS z2, gx, gy FROM g JOIN e USING (frame), range(512) t(y)),
  v AS (SELECT frame, y, x, CAST(500 + ((y * 640 + x) * 7919) % 11 + floor(x * gx + y * gy) AS INT) AS v,
    CASE WHEN flat THEN 0 ELSE z1 + CASE WHEN z1 < z2 THEN 1 ELSE -1 END * ((320 + x * (abs(z1 - z2) + 1)) // 640) END AS ramp FROM r, range(640) u(x)),
  o AS (SELECT frame, y, least(greatest(v - ramp, 0), 65535) AS v FROM v)
  SELECT frame, y, sum(v)::BIGINT AS sum, min(v)::INT AS low, max(v)::INT AS high FROM o GROUP BY frame, y""")
def gradient_remove(spark, sf_dir):
    from ..operators import gradient

    out = gradient.remove(gradient_frames(spark, sf_dir), 640, 512)
    return out.groupBy("frame", "y").agg(F.sum("v").alias("sum"), F.min("v").alias("low"), F.max("v").alias("high"))
