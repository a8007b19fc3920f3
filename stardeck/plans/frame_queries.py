"""Queries over frames: the vectors of `embeddings` are sensor rows, 50 of them a frame of 64 x 50 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import frames as fr
from .registry import query, table

W, H, PATTERN = 64, 50, "RGGB"

#: The same binding in SQL.
PIX = """WITH pix AS (
  SELECT vec_id // 50 AS frame, CAST(vec_id % 50 AS INT) AS y, CAST(unnest(range(len(embedding))) AS INT) AS x,
         CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1.0) * 32767.5) AS INT) AS v FROM embeddings)"""
COLOR = "CASE WHEN {y} % 2 = 0 AND {x} % 2 = 0 THEN 'R' WHEN {y} % 2 = 1 AND {x} % 2 = 1 THEN 'B' ELSE 'G' END"
CFA = COLOR.format(y="y", x="x")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.rows_of_vectors(table(spark, sf_dir, "embeddings"), H)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.to_pixels(rows(spark, sf_dir))


@query(PIX + " SELECT frame, v, count(*) AS freq FROM pix GROUP BY frame, v")
def frame_histogram(spark, sf_dir):
    return fr.histogram(pixels(spark, sf_dir), "frame")


@query(PIX + f" SELECT frame, chan, v, count(*) AS freq FROM (SELECT *, {CFA} AS chan FROM pix) GROUP BY ALL")
def cfa_histogram(spark, sf_dir):
    return fr.histogram(pixels(spark, sf_dir).withColumn("chan", fr.color(PATTERN)), "frame", "chan")


@query(PIX + " SELECT frame, v, count(*) AS freq FROM pix WHERE (y * 64 + x) % 7 = 0 GROUP BY frame, v")
def sampled_histogram(spark, sf_dir):
    return fr.histogram(fr.sampled(pixels(spark, sf_dir), W, 7), "frame")


@query(PIX + """ SELECT frame, count(*) AS count, round(avg(v), 8) AS mean, round(stddev_pop(v), 4) AS std_dev FROM pix GROUP BY frame""")
def frame_stats(spark, sf_dir):
    m = fr.moments(fr.histogram(pixels(spark, sf_dir), "frame"), "frame")
    return m.select("frame", "count", F.round("mean", 8).alias("mean"), F.round("std_dev", 4).alias("std_dev"))


@query(PIX + """, s AS (SELECT frame, list_sort(list(v)) AS a, count(*) AS n FROM pix GROUP BY frame)
  SELECT frame, a[n // 2 + 1] AS median, a[(1 * n + 50) // 100 + 1] AS p1, a[(45 * n + 50) // 100 + 1] AS p45, a[(99 * n + 50) // 100 + 1] AS p99 FROM s""")
def frame_rank(spark, sf_dir):
    n = F.col("count")
    ranks = {"median": fr.median_rank(n)} | {f"p{k}": fr.percentile_rank(k, n) for k in (1, 45, 99)}
    return fr.ranked(fr.histogram(pixels(spark, sf_dir), "frame"), ["frame"], ranks)


@query(PIX + f""", s AS (SELECT frame, {CFA} AS chan, list_sort(list(v)) AS a, count(*) AS n, avg(v) AS mean FROM pix GROUP BY ALL)
  SELECT frame, chan, round(mean, 8) AS mean, a[95 * n // 100 + 1] AS p95 FROM s""")
def flat_info(spark, sf_dir):
    h = fr.histogram(pixels(spark, sf_dir).withColumn("chan", fr.color(PATTERN)), "frame", "chan")
    high = fr.ranked(h, ["frame", "chan"], {"p95": F.floor(95 * F.col("count") / 100)})
    return fr.moments(h, "frame", "chan").join(high, ["frame", "chan"]).select("frame", "chan", F.round("mean", 8).alias("mean"), "p95")


@query(PIX + """ SELECT frame, 65535 AS max_value, round(avg(v), 8) AS mean, list_sort(list(v))[count(*) // 2 + 1] AS median, round(stddev_pop(v), 4) AS std_dev FROM pix GROUP BY frame""")
def raw_stat(spark, sf_dir):
    h = fr.histogram(pixels(spark, sf_dir), "frame")
    both = fr.moments(h, "frame").join(fr.ranked(h, ["frame"], {"median": fr.median_rank(F.col("count"))}), "frame")
    return both.select("frame", F.lit(fr.MAX16).alias("max_value"), F.round("mean", 8).alias("mean"), "median", F.round("std_dev", 4).alias("std_dev"))


@query(PIX + " SELECT frame, CAST(sum(v) // count(*) AS INT) AS background FROM pix GROUP BY frame")
def background(spark, sf_dir):
    return fr.background(pixels(spark, sf_dir))


_NOISE = """, t AS (SELECT frame, pos // 11 AS t, sum(v) AS s, max(v) FILTER (pos % 11 = 5) AS m, count(*) AS n
    FROM (SELECT frame, y * 64 + x AS pos, v FROM pix) WHERE (pos // 11) % 7 = 0 GROUP BY ALL HAVING count(*) = 11),
  d AS (SELECT frame, abs(m - (s - m + 5) // 10) AS d, row_number() OVER (PARTITION BY frame ORDER BY abs(m - (s - m + 5) // 10)) AS r, count(*) OVER (PARTITION BY frame) AS n FROM t),
  noise AS (SELECT frame, sqrt(sum(d * d) / max(80 * n // 100)) AS noise FROM d WHERE r <= 80 * n // 100 GROUP BY frame)"""


@query(PIX + _NOISE + " SELECT frame, round(noise, 6) AS noise FROM noise")
def plane_noise(spark, sf_dir):
    return fr.plane_noise(pixels(spark, sf_dir), W).select("frame", F.round("noise", 6).alias("noise"))


@query(PIX + _NOISE + """ SELECT frame, round(noise, 6) AS noise, background, round(100.0 * background / 65535, 6) AS background_percent
  FROM noise JOIN (SELECT frame, CAST(sum(v) // count(*) AS INT) AS background FROM pix GROUP BY frame) USING (frame)""")
def light_info(spark, sf_dir):
    p = pixels(spark, sf_dir)
    both = fr.plane_noise(p, W).join(fr.background(p), "frame")
    percent = F.round(F.lit(100.0) * F.col("background") / fr.MAX16, 6)
    return both.select("frame", F.round("noise", 6).alias("noise"), "background", percent.alias("background_percent"))


def _clip_sql(rounds: int = 5) -> str:
    cell = "SELECT frame, y // 16 AS cy, x // 16 AS cx, v FROM pix WHERE (y // 16) % 7 = 0 AND (x // 16) % 7 = 0 AND y < 48 AND x < 64"
    parts = [PIX + f", c0 AS ({cell})"]
    for k in range(rounds):
        parts.append(f"""m{k} AS (SELECT frame, cy, cx, list_sort(list(v))[count(*) // 2 + 1] AS med FROM c{k} GROUP BY ALL),
  b{k} AS (SELECT frame, cy, cx, CAST(floor(max(med) + 3.0 * sqrt(sum((v - med) * (v - med)) / count(*)::DOUBLE)) AS INT) AS top FROM c{k} JOIN m{k} USING (frame, cy, cx) GROUP BY ALL),
  c{k + 1} AS (SELECT c.* FROM c{k} c JOIN b{k} USING (frame, cy, cx) WHERE v <= top)""")
    last = f"""q AS (SELECT frame, count(*) AS n, sum(v * v)::DOUBLE - sum(v)::DOUBLE * sum(v) / count(*) AS q FROM c{rounds} GROUP BY frame, cy, cx)
  SELECT frame, round(sqrt(sum(q) / sum(n)), 4) AS noise FROM q GROUP BY frame"""
    return ",\n".join([*parts, last])


@query(_clip_sql())
def raw_noise_clipped(spark, sf_dir):
    return fr.clipped_noise(rows(spark, sf_dir), W, H).select("frame", F.round("noise", 4).alias("noise"))


@query(PIX + " SELECT frame, y, x, v FROM pix WHERE y BETWEEN 10 AND 19 AND x BETWEEN 5 AND 70")
def rect_scan(spark, sf_dir):
    return fr.rect(rows(spark, sf_dir), 5, 10, 70, 19)


@query(PIX + f" SELECT frame, y, x, {CFA} AS color, v FROM pix")
def cfa_color(spark, sf_dir):
    return fr.to_pixels(rows(spark, sf_dir)).withColumn("color", fr.color(PATTERN))


_DARK = """, means AS (SELECT frame, sum(v) // count(*) AS mean FROM pix GROUP BY frame),
  dark AS (SELECT y, x, v AS d FROM pix WHERE frame = 0)"""


@query(PIX + _DARK + """ SELECT frame, y, x, CAST(greatest(0, least(65535, v - d + mean - (SELECT mean FROM means WHERE frame = 0))) AS INT) AS v,
  CAST(mean - (SELECT mean FROM means WHERE frame = 0) AS INT) AS shift FROM pix JOIN dark USING (y, x) JOIN means USING (frame) WHERE frame > 0""")
def dark_subtract(spark, sf_dir):
    r = rows(spark, sf_dir)
    out = cal.subtract_dark(r.where("frame > 0"), r.where("frame = 0"))
    return out.select("frame", "y", F.posexplode("row").alias("x", "v"), "shift")


@query(PIX + """, flat AS (SELECT y, x, 32768 + v // 4 AS f FROM pix WHERE frame = 1)
  SELECT frame, y, x, CAST(greatest(0, least(65535, (v - 100)::BIGINT * 65535 // (f - 200) + 100)) AS INT) AS v FROM pix JOIN flat USING (y, x) WHERE frame > 1""")
def flat_apply(spark, sf_dir):
    r = rows(spark, sf_dir)
    flat = r.where("frame = 1").withColumn("row", F.transform("row", lambda v: F.floor(v / 4).cast("int") + 32768))
    return fr.to_pixels(cal.apply_flat(r.where("frame > 1"), flat, 100, 200))


@query(PIX + f""", c AS (SELECT *, {CFA} AS chan FROM pix),
  top AS (SELECT frame, chan, list_sort(list(v))[99 * count(*) // 100 + 1] - 50 AS top FROM c GROUP BY ALL)
  SELECT frame, y, x, CAST(greatest(0, least(65535, (v - 50)::BIGINT * 65535 // top)) AS INT) AS v FROM c JOIN top USING (frame, chan)""")
def flat_normalize(spark, sf_dir):
    return cal.normalize_flat(rows(spark, sf_dir), PATTERN, 50)


@query(PIX + f""", off AS (SELECT CAST(unnest(range(-2, 3)) AS INT) AS d)
  SELECT p.frame, p.y, p.x, CAST((sum(q.v) + count(*) // 2) // count(*) AS INT) AS v
  FROM pix p, off a, off b JOIN pix q ON q.frame = p.frame AND q.y = p.y + a.d AND q.x = p.x + b.d
  WHERE {COLOR.format(y='p.y', x='p.x')} = {COLOR.format(y='q.y', x='q.x')} GROUP BY p.frame, p.y, p.x""")
def flat_filter_5x5(spark, sf_dir):
    return fr.to_pixels(cal.smooth_flat(rows(spark, sf_dir), PATTERN))


_BAD = "((frame * 7919 + y * 104729 + x * 1299709) % 50 = 0)"


@query(PIX + f""", bad AS (SELECT frame, y, x FROM pix WHERE {_BAD}), off AS (SELECT CAST(unnest(range(-2, 3)) AS INT) AS d),
  near AS (SELECT b.frame, b.y AS ty, b.x AS tx, q.v FROM bad b, off dy, off dx JOIN pix q ON q.frame = b.frame AND q.y = b.y + dy.d AND q.x = b.x + dx.d
    WHERE {COLOR.format(y='b.y', x='b.x')} = {COLOR.format(y='q.y', x='q.x')}
      AND ({COLOR.format(y='b.y', x='b.x')} <> 'G' OR (abs(dy.d) <= 1 AND abs(dx.d) <= 1))
      AND NOT {_BAD.replace('frame', 'q.frame').replace('y *', 'q.y *').replace('x *', 'q.x *')}),
  fixed AS (SELECT frame, ty AS y, tx AS x, CAST(sum(v) // count(*) AS INT) AS v FROM near GROUP BY ALL)
  SELECT frame, y, x, coalesce(f.v, p.v) AS v FROM pix p LEFT JOIN fixed f USING (frame, y, x)""")
def bad_pixel_repair(spark, sf_dir):
    return fr.to_pixels(cal.repair(rows(spark, sf_dir), pixels(spark, sf_dir).where(_BAD), PATTERN))


def _line_sql(name: str, line: str, along: str, n: int) -> str:
    return f"""{name} AS (SELECT frame, y, x, {line} AS line, 7 * v - CASE
      WHEN {along} < 3 THEN sum(v) FILTER ({along} < 7) OVER a WHEN {along} >= {n - 3} THEN sum(v) FILTER ({along} >= {n - 7}) OVER a
      ELSE sum(v) OVER (PARTITION BY frame, {line} ORDER BY {along} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS diff
    FROM spotted WINDOW a AS (PARTITION BY frame, {line})),
  {name}_s AS (SELECT frame, list_sort(list(diff)) AS a, count(*) AS n FROM {name} WHERE diff > 0 AND line % 3 = 0 GROUP BY frame),
  {name}_e AS (SELECT frame, n, trunc(round(0.25 * a[60 * n // 100 + 1] - 0.75 * a[70 * n // 100 + 1] - 0.75 * a[80 * n // 100 + 1] + 2.25 * a[90 * n // 100 + 1], 6)) AS e,
      CAST(list_sum(a[n - 8:n]) AS BIGINT) // 9 AS most FROM {name}_s),
  {name}_b AS (SELECT frame, CASE WHEN n < 100 OR 3 * e >= most THEN 2147483647 ELSE (3 * CAST(e AS BIGINT) + most) // 4 END AS border FROM {name}_e)"""


_SPOT = "CASE WHEN (frame * 31 + y * 17 + x * 7) % 997 = 0 THEN 65000 ELSE 1000 + v // 200 END"


@query(PIX + f""", spotted AS (SELECT frame, y, x, {_SPOT} AS v FROM pix), {_line_sql('r', 'y', 'x', W)}, {_line_sql('c', 'x', 'y', H)}
  SELECT frame, y, x FROM r JOIN r_b USING (frame) WHERE diff > border UNION SELECT frame, y, x FROM c JOIN c_b USING (frame) WHERE diff > border""")
def hot_dark(spark, sf_dir):
    spotted = F.transform("row", lambda v, x: F.when((F.col("frame") * 31 + F.col("y") * 17 + x * 7) % 997 == 0, 65000).otherwise(1000 + F.floor(v / 200).cast("int")))
    return cal.hot_in_dark(rows(spark, sf_dir).withColumn("row", spotted), W, H)


_LIGHT = "CASE WHEN (frame * 13 + y * 17 + x * 7) % 499 = 0 THEN 65000 ELSE 1000 + v // 200 END"


@query(PIX + f""", l AS (SELECT frame, y, x, {_LIGHT} AS v, {CFA} AS c FROM pix),
  n AS (SELECT *, lag(v) OVER w AS v1, lead(v) OVER w AS v2 FROM l WINDOW w AS (PARTITION BY frame, y, x % 2 ORDER BY x)),
  peaks AS (SELECT * FROM n WHERE v > v1 AND v > v2),
  p99 AS (SELECT frame, c, list_sort(list(v - (v1 + v2) // 2))[99 * count(*) // 100 + 1] AS p FROM peaks
    WHERE (c = 'R' AND y % 8 = 0) OR (c = 'G' AND y % 4 = 0) OR (c = 'B' AND (y - 1) % 8 = 0) GROUP BY ALL),
  strong AS (SELECT k.*, least(greatest(150 * p // 100, 65), 32767) AS border FROM peaks k JOIN p99 USING (frame, c)),
  off AS (SELECT o, a * o AS dy, b * o AS dx FROM (VALUES (4), (6)) t(o), (VALUES (-1), (0), (1)) u(a), (VALUES (-1), (0), (1)) w(b) WHERE a <> 0 OR b <> 0),
  ring AS (SELECT s.frame, s.y, s.x, o, sum(q.v) // count(*) AS m FROM strong s, off JOIN l q ON q.frame = s.frame AND q.y = s.y + dy AND q.x = s.x + dx GROUP BY ALL),
  low AS (SELECT frame, y, x, min(m) AS low FROM ring GROUP BY ALL)
  SELECT frame, y, x FROM strong JOIN low USING (frame, y, x)
  WHERE v - v1 > border AND v - v2 > border AND v - v1 > 2 * (v1 - low) AND v - v2 > 2 * (v2 - low)""")
def hot_light(spark, sf_dir):
    spotted = F.transform("row", lambda v, x: F.when((F.col("frame") * 13 + F.col("y") * 17 + x * 7) % 499 == 0, 65000).otherwise(1000 + F.floor(v / 200).cast("int")))
    return cal.hot_in_light(rows(spark, sf_dir).withColumn("row", spotted), PATTERN)


@query(PIX + f""", off AS (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS d),
  near AS (SELECT p.frame, p.y, p.x, p.v, {COLOR.format(y='p.y', x='p.x')} AS mine, {COLOR.format(y='q.y', x='q.x')} AS other, q.v AS qv
    FROM pix p, off a, off b JOIN pix q ON q.frame = p.frame AND q.y = p.y + a.d AND q.x = p.x + b.d),
  m AS (SELECT frame, y, x, max(v) AS v, max(mine) AS mine,
      {', '.join(f"(sum(qv) FILTER (other = '{c}') + count(*) FILTER (other = '{c}') // 2) // count(*) FILTER (other = '{c}') AS m{c}" for c in 'RGB')} FROM near GROUP BY frame, y, x)
  SELECT frame, y, x, {', '.join(f"CAST(CASE WHEN mine = '{c}' AND y BETWEEN 1 AND 48 AND x BETWEEN 1 AND 62 THEN v ELSE m{c} END AS INT) AS {c.lower()}" for c in 'RGB')} FROM m""")
def demosaic_rggb(spark, sf_dir):
    d = cal.demosaic(rows(spark, sf_dir), W, H, PATTERN)
    return d.select("frame", "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p")).select("frame", "y", "x", "p.r", "p.g", "p.b")


@query(PIX + " SELECT frame, k, CAST(y // k AS INT) AS y, CAST(x // k AS INT) AS x, CAST((sum(v) + k * k // 2) // (k * k) AS INT) AS v FROM pix, (VALUES (2), (3), (4)) t(k) GROUP BY frame, k, y // k, x // k HAVING count(*) = k * k")
def block_mean_2_3_4(spark, sf_dir):
    p = pixels(spark, sf_dir)
    parts = [fr.block_mean(p, k).select("frame", F.lit(k).alias("k"), "y", "x", "v") for k in (2, 3, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(PIX + """, s AS (SELECT frame, list_sort(list(v)) AS a, count(*) AS n FROM pix GROUP BY frame),
  p AS (SELECT frame, a[(n + 50) // 100 + 1] AS p1, a[(60 * n + 50) // 100 + 1] AS p60, a[(95 * n + 50) // 100 + 1] AS p95 FROM s),
  l AS (SELECT frame, p60 + (p1 - p60) * 0.5e0 AS dark, 65535e0 + (p95 - 65535e0) * pow(0.5e0, 0.05e0) AS light FROM p)
  SELECT frame, round(dark, 4) AS dark, round(light, 4) AS light FROM l""")
def preview_levels(spark, sf_dir):
    levels = fr.preview_levels(fr.histogram(pixels(spark, sf_dir), "frame"), ["frame"])
    return levels.select("frame", F.round("dark", 4).alias("dark"), F.round("light", 4).alias("light"))


@query(PIX + """, s AS (SELECT frame, list_sort(list(v)) AS a, count(*) AS n FROM pix GROUP BY frame),
  p AS (SELECT frame, a[(n + 50) // 100 + 1] AS p1, a[(60 * n + 50) // 100 + 1] AS p60, a[(95 * n + 50) // 100 + 1] AS p95 FROM s),
  l AS (SELECT frame, p60 + (p1 - p60) * 0.5e0 AS dark, 65535e0 + (p95 - 65535e0) * pow(0.5e0, 0.05e0) AS light FROM p),
  t AS (SELECT frame, y, x, (v - dark) / (light - dark) AS t FROM pix JOIN l USING (frame))
  SELECT frame, y, x, CASE WHEN t < 0 THEN 0 WHEN t > 1 THEN 255 ELSE CAST(floor(pow(t, 1 / 2.2e0) * 255) AS INT) END AS level FROM t""")
def preview_tone(spark, sf_dir):
    p = pixels(spark, sf_dir)
    levels = fr.preview_levels(fr.histogram(p, "frame"), ["frame"])
    return p.join(levels, "frame").select("frame", "y", "x", fr.tone(F.col("v"), F.col("dark"), F.col("light")).alias("level"))


#: Of each five frames two are darks, one is a flat and two are lights; a frame's setting is whether its number is odd, its time the number.
@query(PIX + f""", pairs AS (SELECT l.frame, max(d.frame) AS dark FROM (SELECT DISTINCT frame FROM pix) l JOIN (SELECT DISTINCT frame FROM pix) d ON d.frame < l.frame AND d.frame % 2 = l.frame % 2 AND d.frame % 5 < 2 WHERE l.frame % 5 > 2 GROUP BY l.frame),
  flats AS (SELECT l.frame, max(d.frame) AS flat FROM (SELECT DISTINCT frame FROM pix) l JOIN (SELECT DISTINCT frame FROM pix) d ON d.frame < l.frame AND d.frame % 2 = l.frame % 2 AND d.frame % 5 = 2 WHERE l.frame % 5 > 2 GROUP BY l.frame),
  means AS (SELECT frame, sum(v) // count(*) AS mean FROM pix GROUP BY frame), off AS (SELECT CAST(unnest(range(-2, 3)) AS INT) AS d),
  raw AS (SELECT frame, y, x, 32768 + v // 4 AS v FROM pix WHERE frame % 5 = 2),
  smooth AS (SELECT p.frame, p.y, p.x, (sum(q.v) + count(*) // 2) // count(*) AS f FROM raw p, off a, off b JOIN raw q ON q.frame = p.frame AND q.y = p.y + a.d AND q.x = p.x + b.d
    WHERE {COLOR.format(y='p.y', x='p.x')} = {COLOR.format(y='q.y', x='q.x')} GROUP BY p.frame, p.y, p.x),
  less AS (SELECT p.frame, p.y, p.x, coalesce(m.mean - n.mean, 0) AS shift, greatest(0, least(65535, p.v - coalesce(d.v, 0) + coalesce(m.mean - n.mean, 0))) AS v
    FROM pix p LEFT JOIN pairs k ON k.frame = p.frame LEFT JOIN pix d ON d.frame = k.dark AND d.y = p.y AND d.x = p.x LEFT JOIN means m ON m.frame = p.frame LEFT JOIN means n ON n.frame = k.dark WHERE p.frame % 5 > 2)
  SELECT l.frame, l.y, l.x, CAST(CASE WHEN s.f IS NULL THEN v ELSE greatest(0, least(65535, CAST(trunc((v - 100 - shift)::BIGINT * 65535::DOUBLE / (s.f - 200)) AS BIGINT) + 100 + shift)) END AS INT) AS v,
    CAST(CASE WHEN k.dark IS NULL THEN 0 ELSE 5 END + CASE WHEN t.flat IS NULL THEN 0 ELSE 8 END AS INT) AS done
  FROM less l LEFT JOIN flats t ON t.frame = l.frame LEFT JOIN smooth s ON s.frame = t.flat AND s.y = l.y AND s.x = l.x LEFT JOIN pairs k ON k.frame = l.frame""")
def calibrate_settings(spark, sf_dir):
    """Lights of two settings by the masters of each that came before them."""
    from ..operators import library

    r = rows(spark, sf_dir).withColumn("setting", F.expr("cast(frame % 2 as string)"))
    flat = F.expr("frame % 5 = 2")
    row = F.when(flat, F.transform("row", lambda v: F.floor(v / 4).cast("int") + 32768)).otherwise(F.col("row"))
    masters = r.where("frame % 5 <= 2").select(F.col("frame").alias("master"), F.when(flat, "flat").otherwise("dark").alias("kind"), "setting", F.col("frame").alias("since"), F.lit(200).alias("offset"), "y", row.alias("row"))
    lights = r.where("frame % 5 > 2")
    frames = lights.select("frame", "setting", F.col("frame").alias("time"), F.lit(100).alias("offset")).distinct()
    out = library.calibrate_by(lights, frames, library.prepare(masters, W, H, PATTERN, defects=False), PATTERN)
    return out.select("frame", "y", F.posexplode("row").alias("x", "v"), "done")
