"""Queries over files, messages and previews of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..sources import fits, tables
from .frame_queries import CFA, PATTERN, PIX, H, W, pixels, rows
from .registry import query, table


def _files(spark, sf_dir):
    return fits.to_files(rows(spark, sf_dir)).select(F.concat(F.lit("frame_"), F.col("frame").cast("string"), F.lit(".fits")).alias("path"), "content")


@query(PIX + " SELECT 'frame_' || frame || '.fits' AS path, y, x, v FROM pix WHERE frame IN (SELECT frame FROM pix GROUP BY frame)")
def fits_round_trip(spark, sf_dir):
    """Frames written as FITS files and read again."""
    return fits.first_image(fits.rows_of(_files(spark, sf_dir))).select("path", "y", F.posexplode("row").alias("x", "v"))


@query("SELECT 'frame_' || vec_id // 50 || '.fits' AS path, 64 AS width, CAST(count(*) AS INT) AS height, 65535 AS max_value, 'Light' AS frame_type, 0e0 AS exposure, 1 AS bin, 0 AS gain, 0 AS \"offset\", '' AS camera FROM embeddings GROUP BY vec_id // 50")
def fits_headers(spark, sf_dir):
    return fits.frame_info(fits.headers_of(_files(spark, sf_dir))).select("path", "width", "height", "max_value", "frame_type", "exposure", "bin", "gain", "offset", "camera")


_INFO = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 255 ELSE 65535 END AS max_value, 64 AS width, 50 AS height, p_size / 4e0 AS exposure, CASE WHEN p_size % 2 = 0 THEN p_size * 2e0 END AS integr_time, 'Dark' AS frame_type,
    p_partkey % 4 AS bin, p_partkey % 7 AS gain, p_partkey % 5 AS offset_, p_brand AS camera, CASE WHEN p_partkey % 4 > 0 THEN 'RGGB' END AS cfa, CASE WHEN p_size % 3 = 0 THEN p_size - 25.5e0 END AS ccd_temp FROM part"""


@query(f"""WITH i AS ({_INFO}), c AS (SELECT p_partkey, unnest([['SIMPLE', 'T'], ['BITPIX', CASE WHEN max_value > 255 THEN '16' ELSE '8' END], ['NAXIS', '2'], ['NAXIS1', '64'], ['NAXIS2', '50'], ['EXTEND', 'T'], ['BZERO', CASE WHEN max_value > 255 THEN '32768' END],
    ['EXPTIME', CAST(exposure AS VARCHAR)], ['TOTALEXP', CAST(integr_time AS VARCHAR)], ['ROWORDER', 'TOP-DOWN'], ['FRAME', frame_type], ['XBINNING', CAST(bin AS VARCHAR)], ['YBINNING', CAST(bin AS VARCHAR)], ['GAIN', CAST(gain AS VARCHAR)],
    ['OFFSET', CAST(offset_ AS VARCHAR)], ['INSTRUME', camera], ['BAYERPAT', cfa], ['CCD-TEMP', CAST(ccd_temp AS VARCHAR)]]) AS c FROM i) SELECT p_partkey, c[1] AS key, c[2] AS value FROM c WHERE c[2] IS NOT NULL""")
def fits_cards(spark, sf_dir):
    i = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN 255 ELSE 65535 END AS max_value", "64 AS width", "50 AS height", "p_size / 4e0 AS exposure", "CASE WHEN p_size % 2 = 0 THEN p_size * 2e0 END AS integr_time", "'Dark' AS frame_type",
        "p_partkey % 4 AS bin", "p_partkey % 7 AS gain", "p_partkey % 5 AS offset", "p_brand AS camera", "CASE WHEN p_partkey % 4 > 0 THEN 'RGGB' END AS cfa", "CASE WHEN p_size % 3 = 0 THEN p_size - 25.5e0 END AS ccd_temp",
    )
    return fits.info_cards(i).select("p_partkey", F.explode("cards").alias("key", "value"))


@query(PIX + """, p AS (SELECT event_id, user_id % 12 AS frame, CAST(event_id % 60 AS INT) - 5 AS y, CAST(event_id * 7 % 80 AS INT) - 8 AS x FROM events)
  SELECT event_id, p.frame, p.y, p.x, v FROM p LEFT JOIN pix USING (frame, y, x)""")
def pixel_at(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 12 AS frame", "cast(event_id % 60 as int) - 5 AS y", "cast(event_id * 7 % 80 as int) - 8 AS x")
    return fr.pixel_at(rows(spark, sf_dir), p).select("event_id", "frame", "y", "x", "v")


@query(PIX + f""", m AS (SELECT frame, {CFA} AS chan, list_sort(list(v))[count(*) // 2 + 1] AS median FROM pix GROUP BY ALL) SELECT frame, min(median) AS low, max(median) AS high FROM m GROUP BY frame""")
def channel_extremes(spark, sf_dir):
    h = fr.histogram(pixels(spark, sf_dir).withColumn("chan", fr.color(PATTERN)), "frame", "chan")
    return fr.channel_extremes(fr.ranked(h, ["frame", "chan"], {"median": fr.median_rank(F.col("count"))}))


@query(PIX + " SELECT frame, 'L' AS chan, y, CAST(sum(v) AS BIGINT) AS light, count(*) AS n FROM pix GROUP BY frame, y")
def mono_copy(spark, sf_dir):
    m = fr.monochrome(rows(spark, sf_dir)).select("frame", "chan", "y", F.explode("row").alias("v"))
    return m.groupBy("frame", "chan", "y").agg(F.sum("v").alias("light"), F.count("*").alias("n"))


@query(PIX + f""", c AS (SELECT *, {CFA} AS chan FROM pix), s AS (SELECT frame, chan, list_sort(list(v)) AS a, count(*) AS n FROM c GROUP BY ALL),
  q AS (SELECT frame, chan, a[(n + 50) // 100 + 1] AS p1, a[(60 * n + 50) // 100 + 1] AS p60, a[(95 * n + 50) // 100 + 1] AS p95, a[(45 * n + 50) // 100 + 1] AS p45 FROM s),
  g AS (SELECT frame, p45, p60 + (p1 - p60) * 0.5e0 AS dark, 65535e0 + (p95 - 65535e0) * pow(0.5e0, 0.05e0) AS light FROM q WHERE chan = 'G'),
  l AS (SELECT q.frame, chan, dark + (q.p45 - g.p45) AS dark, light + (q.p45 - g.p45) AS light, CASE chan WHEN 'R' THEN 1.5e0 WHEN 'G' THEN 1e0 ELSE 1.25e0 END AS k FROM q JOIN g USING (frame)),
  t AS (SELECT frame, y, x, chan, (v - dark) / (light - dark) * k AS t FROM c JOIN l USING (frame, chan))
  SELECT frame, y, x, chan, CASE WHEN t < 0 THEN 0 WHEN t > 1 THEN 255 ELSE CAST(floor(pow(t, 1 / 2.2e0) * 255) AS INT) END AS level FROM t""")
def preview_balanced(spark, sf_dir):
    """The colours of a preview with white balance, on the raw pixels of each colour."""
    p = pixels(spark, sf_dir).withColumn("chan", fr.color(PATTERN))
    levels = fr.rgb_levels(fr.histogram(p, "frame", "chan"))
    gain = F.when(F.col("chan") == "R", 1.5).when(F.col("chan") == "G", 1.0).otherwise(1.25)
    return p.join(levels, ["frame", "chan"]).select("frame", "y", "x", "chan", fr.tone(F.col("v"), F.col("dark"), F.col("light"), gain=gain).alias("level"))


@query(PIX + """, a(i, s, d) AS (VALUES (0, 0, 0), (1, 27, 16), (2, 54, 32)), b(j, s, d) AS (VALUES (0, 0, 0), (1, 20, 16), (2, 40, 32))
  SELECT frame, CAST(y - b.s + b.d AS INT) AS y, CAST(x - a.s + a.d AS INT) AS x, v FROM pix JOIN a ON x BETWEEN a.s AND a.s + 9 JOIN b ON y BETWEEN b.s AND b.s + 9""")
def preview_mosaic(spark, sf_dir):
    return fr.corners_and_centre(rows(spark, sf_dir), W, H, 42)


_THERE = "'shot' || (p_partkey % 40) || CASE WHEN p_size % 3 = 0 THEN '' ELSE '_' || (2 + (p_size + p_partkey) % 4) END || CASE WHEN p_partkey % 40 % 2 = 0 THEN '.fit' ELSE '' END"


@query(f"""WITH e AS (SELECT DISTINCT {_THERE} AS name FROM part WHERE p_size % 5 < 3), w AS (SELECT 'shot' || n_nationkey * 2 AS stem, CASE WHEN n_nationkey * 2 % 2 = 0 AND n_nationkey % 3 > 0 THEN '.fit' ELSE '' END AS ending FROM nation),
  f AS (SELECT stem || ending AS name, min(k) AS k FROM w, (SELECT unnest(range(2, 9)) AS k) WHERE stem || '_' || k || ending NOT IN (SELECT name FROM e) GROUP BY stem, ending, name)
  SELECT w.stem || w.ending AS name, CASE WHEN w.stem || w.ending IN (SELECT name FROM e) THEN w.stem || '_' || f.k || w.ending ELSE w.stem || w.ending END AS free FROM w JOIN f ON f.name = w.stem || w.ending""")
def free_names(spark, sf_dir):
    there = "concat('shot', p_partkey % 40, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('_', 2 + (p_size + p_partkey) % 4) END, CASE WHEN p_partkey % 40 % 2 = 0 THEN '.fit' ELSE '' END) AS name"
    e = table(spark, sf_dir, "part").where("p_size % 5 < 3").selectExpr(there)
    w = table(spark, sf_dir, "nation").selectExpr("concat('shot', n_nationkey * 2, CASE WHEN n_nationkey % 3 > 0 THEN '.fit' ELSE '' END) AS name")
    return tables.free_names(w, e)


@query("""WITH e AS (SELECT *, ['Number', 'Text', 'Switch'][event_id % 3 + 1] AS k, ['def', 'set'][event_id % 2 + 1] AS verb, unnest(['A', 'B']) AS elem FROM events WHERE event_id % 7 > 0)
  SELECT event_id, verb, CASE k WHEN 'Number' THEN 'Num' ELSE k END AS kind, 'dev ' || user_id AS device, event_type AS prop, elem,
    CASE WHEN k = 'Number' THEN CASE elem WHEN 'A' THEN value ELSE event_id END END AS num, CASE WHEN k = 'Text' THEN CASE elem WHEN 'A' THEN 'a < b' ELSE event_type END END AS text,
    CASE WHEN k = 'Switch' THEN (event_id % 4 < 2) = (elem = 'A') END AS switch, CASE WHEN event_id % 5 = 0 THEN 'Busy' ELSE 'Ok' END AS state FROM e""")
def device_messages(spark, sf_dir):
    """Vectors of numbers, texts and switches as XML, and lines that are none, parsed."""
    xml = """CASE WHEN event_id % 7 = 0 THEN 'no vector' ELSE concat('<', verb, k, "Vector device='dev ", user_id, "' name='", event_type, "' state='", CASE WHEN event_id % 5 = 0 THEN 'Busy' ELSE 'Ok' END, "'>",
      '<', one, k, " name='A'> ", CASE k WHEN 'Number' THEN cast(value as string) WHEN 'Text' THEN 'a &lt; b' ELSE CASE WHEN event_id % 4 < 2 THEN 'On' ELSE 'Off' END END, ' </', one, k, '>',
      '<', one, k, " name='B'>", CASE k WHEN 'Number' THEN cast(event_id as string) WHEN 'Text' THEN event_type ELSE CASE WHEN event_id % 4 < 2 THEN 'off' ELSE 'ON' END END, '</', one, k, '></', verb, k, 'Vector>') END AS value"""
    e = table(spark, sf_dir, "events").selectExpr("*", "element_at(array('Number', 'Text', 'Switch'), cast(event_id % 3 + 1 as int)) AS k", "element_at(array('def', 'set'), cast(event_id % 2 + 1 as int)) AS verb", "element_at(array('def', 'one'), cast(event_id % 2 + 1 as int)) AS one")
    d = tables.device_properties(e.selectExpr("event_id", xml))
    return d.select("event_id", "verb", "kind", "device", "prop", "elem", "num", "text", "switch", "state")


@query("SELECT CAST(user_id AS INT) AS x, CAST(event_id AS INT) AS y FROM events WHERE event_id % 3 > 0")
def bad_pixel_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 3 > 0 THEN concat('  ', user_id, ' ', event_id) WHEN event_id % 2 = 0 THEN event_type ELSE '12' END AS value")
    return tables.bad_pixels_of(lines)
