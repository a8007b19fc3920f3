"""Queries over stacks of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stacking as st
from .frame_queries import CFA, PATTERN, PIX, H, W, pixels, rows
from .registry import query

#: Offsets of each frame in the warp queries.
OFFSETS = [
    "frame % 3 - 1.5e0 AS dx",
    "0.25e0 * (frame % 4) AS dy",
    "CASE WHEN frame % 5 = 4 THEN 0.5e0 WHEN frame % 5 = 3 THEN -0.01e0 ELSE 0e0 END AS angle",
]


@query(PIX + " SELECT y, x, CAST((sum(v) + count(*) // 2) // count(*) AS INT) AS v FROM pix GROUP BY y, x")
def stack_average(spark, sf_dir):
    return st.average(rows(spark, sf_dir))


@query(PIX + """, n AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT frame FROM pix)),
  m AS (SELECT y, x, i // 5 AS five, list_sort(list(v))[3] AS m FROM pix JOIN n USING (frame) GROUP BY y, x, i // 5 HAVING count(*) = 5)
  SELECT y, x, CAST((sum(m) + count(*) // 2) // count(*) AS INT) AS v FROM m GROUP BY y, x""")
def stack_avg_of_medians(spark, sf_dir):
    return st.average_of_medians(rows(spark, sf_dir))


_WARP = f""", off AS (SELECT frame, {", ".join(OFFSETS)} FROM (SELECT DISTINCT frame FROM pix)),
  f AS (SELECT frame, CAST(round(dx * 256) AS BIGINT) AS tx, CAST(round(dy * 256) AS BIGINT) AS ty,
      CAST(round(cos(-angle) * 65536) AS BIGINT) AS c, CAST(round(sin(-angle) * 65536) AS BIGINT) AS s FROM off),
  g AS (SELECT p.frame, p.y, p.x, 8064 + ((x * 256 - tx - 8064) * c - (y * 256 - ty - 6272) * s) // 65536 AS sx,
      6272 + ((y * 256 - ty - 6272) * c + (x * 256 - tx - 8064) * s) // 65536 AS sy FROM pix p JOIN f USING (frame)),
  i AS (SELECT *, sx // 256 AS ix, sy // 256 AS iy, ((sx % 256) + 256) % 256 AS u, ((sy % 256) + 256) % 256 AS w FROM g),
  k AS (SELECT i.*, a.v AS v00, b.v AS v10, c.v AS v01, d.v AS v11 FROM i
      LEFT JOIN pix a ON a.frame = i.frame AND a.y = iy AND a.x = ix LEFT JOIN pix b ON b.frame = i.frame AND b.y = iy AND b.x = ix + 1
      LEFT JOIN pix c ON c.frame = i.frame AND c.y = iy + 1 AND c.x = ix LEFT JOIN pix d ON d.frame = i.frame AND d.y = iy + 1 AND d.x = ix + 1),
  l AS (SELECT frame, y, x, w, coalesce(v00 * (256 - u) + v10 * u, v00 * 256, v10 * 256) AS top, coalesce(v01 * (256 - u) + v11 * u, v01 * 256, v11 * 256) AS bot FROM k),
  warped AS (SELECT frame, y, x, CAST(coalesce(top * (256 - w) + bot * w, top * 256, bot * 256) // 65536 AS INT) AS v FROM l)"""


def _offsets(p):
    return p.select("frame").distinct().selectExpr("frame", *OFFSETS)


@query(PIX + _WARP + " SELECT frame, y, x, v FROM warped")
def bilinear_sample(spark, sf_dir):
    r = rows(spark, sf_dir)
    return st.warp(r, _offsets(r), W, H)


@query(PIX + _WARP + " SELECT y, x, CAST(coalesce(sum(v) // nullif(count(v), 0), 0) AS INT) AS v, count(v) AS cnt FROM warped GROUP BY y, x")
def warp_stack(spark, sf_dir):
    r = rows(spark, sf_dir)
    return st.warped_average(r, _offsets(r), W, H)


_MEDIANS = PIX + """, bg AS (SELECT frame, CAST(list_sort(list(v))[count(*) // 2 + 1] AS INT) AS b FROM pix GROUP BY frame),
  five AS (SELECT frame, list_sort(list(b) OVER (ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS a FROM bg),
  d AS (SELECT p.frame, y, x, list_sort(list(greatest(v, 1) - b) OVER (PARTITION BY y, x ORDER BY p.frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS a
    FROM pix p JOIN bg USING (frame)),
  o AS (SELECT y, x, greatest(d.a[3] + five.a[3], 0) AS o FROM d JOIN five USING (frame) WHERE len(five.a) = 5)
  SELECT y, x, CAST(least(sum(o) // count(*), 65535) AS INT) AS v, count(*) AS cnt FROM o GROUP BY y, x"""


@query(_MEDIANS)
def sliding_median_stack(spark, sf_dir):
    from ..operators.frames import histogram, median_rank, ranked

    p = pixels(spark, sf_dir)
    b = ranked(histogram(p, "frame"), ["frame"], {"background": median_rank(F.col("count"))})
    return st.sliding_median(rows(spark, sf_dir), b)


@query(PIX + """, good AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT frame FROM pix WHERE frame % 4 <> 3)),
  m AS (SELECT y, x, i // 5 AS five, list_sort(list(v))[3] AS m FROM pix JOIN good USING (frame) GROUP BY y, x, i // 5 HAVING count(*) = 5)
  SELECT y, x, CAST((sum(m) + count(*) // 2) // count(*) AS INT) AS v FROM m GROUP BY y, x""")
def master_build(spark, sf_dir):
    """A master dark of the frames whose temperature was right: three of four."""
    from ..operators.calibration import build_master

    r = rows(spark, sf_dir)
    return build_master(r, _in_time(r), "dark", None)


def _in_time(r: DataFrame) -> DataFrame:
    """The frames that the quality gate lets through by their temperature: all but every fourth, which is 5 degrees too warm."""
    from ..operators.calibration import noise_gate

    f = r.select("frame").distinct().selectExpr(
        "frame", "true AS cooler_on", "true AS check_temp", "-10e0 + CASE WHEN frame % 4 = 3 THEN 5e0 ELSE frame % 3 / 5e0 END AS temp", "-10e0 AS target_temp", "1e0 AS max_diff",
        "false AS check_fwhm", "cast(null as double) AS fwhm", "0e0 AS max_fwhm", "false AS check_ovality", "cast(null as double) AS ovality", "0e0 AS max_ovality", "true AS offset_found",
    )
    return noise_gate(f).where("temp_ok AND is_ok").select("frame")


@query(PIX + f""", c AS (SELECT *, {CFA} AS chan FROM pix WHERE frame % 4 <> 3), top AS (SELECT frame, chan, list_sort(list(v))[99 * count(*) // 100 + 1] - 50 AS top FROM c GROUP BY ALL),
  f AS (SELECT frame, y, x, CAST(greatest(0, least(65535, (v - 50)::BIGINT * 65535 // top)) AS INT) AS v FROM c JOIN top USING (frame, chan)),
  good AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT frame FROM f)),
  m AS (SELECT y, x, i // 5 AS five, list_sort(list(v))[3] AS m FROM f JOIN good USING (frame) GROUP BY y, x, i // 5 HAVING count(*) = 5)
  SELECT y, x, CAST((sum(m) + count(*) // 2) // count(*) AS INT) AS v FROM m GROUP BY y, x""")
def master_flat(spark, sf_dir):
    """A master flat: frames less their offset, normalised by colour, of those whose temperature was right."""
    from ..operators.calibration import build_master

    r = rows(spark, sf_dir)
    return build_master(r, _in_time(r), "flat", PATTERN, 50)


@query(_MEDIANS)
def live_stack(spark, sf_dir):
    """The stack of sliding medians as a stream: the frames come in two halves, each with what the first has left as state."""
    from ..operators.cuts import shared_path
    from ..operators.frames import histogram, median_rank, ranked
    from ..streaming import live_stack as ls

    b = ranked(histogram(pixels(spark, sf_dir), "frame"), ["frame"], {"background": median_rank(F.col("count"))})
    blocks = rows(spark, sf_dir).join(b, "frame").selectExpr("0L session", "'L' channel", "y", "frame", "cast(background as long) background", "row")
    middle = blocks.agg(F.percentile_approx("frame", 0.5)).first()[0] or 0
    at, store = shared_path(spark, "live"), "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(store, None)
    ls.keep_state(spark)
    try:
        for part in ("frame <= {}", "frame > {}"):
            blocks.where(part.format(middle)).write.mode("append").parquet(f"{at}/in")
            stream = ls.live_stack(spark.readStream.schema(ls.BLOCKS).parquet(f"{at}/in"), tracks=False)
            write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
            stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, held) if held else spark.conf.unset(store)
    last = ls.latest(spark.read.schema(ls.STACKED).parquet(f"{at}/out")).where("frames >= 5")
    return last.select("y", F.posexplode(F.arrays_zip("v", "cnt")).alias("x", "p")).selectExpr("y", "x", "p.v AS v", "cast(p.cnt as long) AS cnt")
