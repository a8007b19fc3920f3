"""Queries over devices, camera settings, file names and plots, bound to the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import text
from ..functions.sky import lit
from ..operators import calibration as cal
from ..operators import devices as dev
from .registry import query, table


@query("""WITH s AS (SELECT p_partkey, p_size * p_partkey * 1.7e0 AS s FROM part), c AS (SELECT *, CAST(floor(s) AS BIGINT) AS n FROM s)
  SELECT p_partkey,
    CASE WHEN n >= 3600 THEN n // 3600 || ' h. ' || n // 60 % 60 || ' min.' WHEN n >= 60 THEN n // 60 || ' min.' ELSE n || ' sec.' END AS long,
    CASE WHEN n >= 3600 THEN n // 3600 || 'h' || n // 60 % 60 || 'm' WHEN n >= 60 THEN n // 60 || 'm' ELSE n || 's' END AS short FROM c""")
def duration_text(spark, sf_dir):
    s = F.col("p_size") * F.col("p_partkey") * 1.7
    return table(spark, sf_dir, "part").select("p_partkey", text.duration_text(s).alias("long"), text.duration_text(s, True).alias("short"))


@query("""SELECT p_partkey, CASE WHEN f & 1 > 0 THEN 'D' ELSE '' END || CASE WHEN f & 2 > 0 THEN 'B' ELSE '' END || CASE WHEN f & 4 > 0 THEN 'P' ELSE '' END
    || CASE WHEN f & 8 > 0 THEN 'F' ELSE '' END || CASE WHEN f & 16 > 0 THEN 'S' ELSE '' END AS flags FROM (SELECT p_partkey, p_partkey % 32 AS f FROM part)""")
def flags_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.flags_text(F.col("p_partkey") % 32).alias("flags"))


#: Settings of a frame, from a part: kind, exposure in seconds, temperature (null for some), binning and date.
_FRAME = """SELECT p_partkey, ['light', 'flat', 'dark', 'bias'][p_partkey % 4 + 1] AS kind, p_partkey % 5 AS e, p_size AS s, p_partkey % 3 AS gain, p_partkey % 2 AS offs, [1, 2, 4][p_partkey % 3 + 1] AS bin,
    CASE WHEN p_size % 6 > 0 THEN (p_size - 25) / 2e0 END AS temp, DATE '2024-01-01' + CAST(p_size AS INT) AS day FROM part"""
_EXPOSURE = "CASE WHEN e = 0 THEN '250ms' WHEN e = 1 THEN '5005us' ELSE s || 's' END"
_PARTS = """'_g' || gain || '_offs' || offs || '_640x480' || CASE WHEN bin <> 1 THEN '_bin' || bin || 'x' || bin ELSE '' END
    || CASE WHEN temp IS NULL THEN '' ELSE '_' || CASE WHEN temp < 0 THEN '-' ELSE '+' END || CAST(CAST(round_even(abs(temp), 0) AS INT) AS VARCHAR) || 'C' END"""


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "element_at(array('light', 'flat', 'dark', 'bias'), cast(p_partkey % 4 + 1 as int)) AS kind", "CASE p_partkey % 5 WHEN 0 THEN 0.2498e0 WHEN 1 THEN 0.005005e0 / 1.0000008e0 * 1e0 ELSE p_size END AS exposure",
        "p_partkey % 3 AS gain", "p_partkey % 2 AS offs", "element_at(array(1, 2, 4), cast(p_partkey % 3 + 1 as int)) AS bin", "CASE WHEN p_size % 6 > 0 THEN (p_size - 25) / 2e0 END AS temp", "date_add(DATE '2024-01-01', p_size) AS day",
    )


def _settings():
    return [F.col("kind"), F.col("exposure"), F.col("gain"), F.col("offs"), F.lit(640), F.lit(480), F.col("bin"), F.col("temp"), F.col("day")]


@query(f"""WITH f AS ({_FRAME}), k AS (SELECT *, kind || CASE WHEN kind = 'bias' THEN '' ELSE '_' || {_EXPOSURE.replace("'5005us'", "'5ms'")} END || {_PARTS} || CASE WHEN kind = 'flat' THEN '_' || strftime(day, '%Y-%m-%d') ELSE '' END || '.fit' AS master FROM f),
  m AS (SELECT master, min(p_partkey) AS first FROM k WHERE p_partkey % 10 < 3 GROUP BY master) SELECT p_partkey, master, first FROM k LEFT JOIN m USING (master)""")
def master_lookup(spark, sf_dir):
    """The master's file name of each frame's settings, and the first that was made under it."""
    k = _frames(spark, sf_dir).select("p_partkey", text.master_name(*_settings()).alias("master"))
    made = k.where("p_partkey % 10 < 3").groupBy("master").agg(F.min("p_partkey").alias("first"))
    return k.join(made, "master", "left").select("p_partkey", "master", "first")


@query(f"""WITH f AS ({_FRAME}) SELECT p_partkey, kind || '_' || strftime(day, '%Y-%m-%d') || '__' || {_EXPOSURE.replace("'5005us'", "'5ms'")} || {_PARTS} AS folder,
    'defect_pixels_640x480' || CASE WHEN bin <> 1 THEN '_bin' || bin || 'x' || bin ELSE '' END || '.txt' AS defects FROM f""")
def capture_names(spark, sf_dir):
    return _frames(spark, sf_dir).select("p_partkey", text.raw_folder(*_settings()).alias("folder"), text.defect_name(F.lit(640), F.lit(480), F.col("bin")).alias("defects"))


@query("""WITH n AS (SELECT c_custkey, c_acctbal AS v, c_custkey % 4 AS k FROM customer),
  u AS (SELECT *, floor(abs(v)) AS h0, CAST(floor(round((abs(v) - floor(abs(v))) * 360000 + 50, 6)) AS BIGINT) AS c0 FROM n),
  s AS (SELECT *, h0 + c0 // 360000 AS h, c0 % 360000 AS c FROM u)
  SELECT c_custkey, CASE k WHEN 0 THEN lpad(printf('%.1f', v), CAST(greatest(9, length(printf('%.1f', v))) AS INT), ' ')
    WHEN 1 THEN CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END
    WHEN 2 THEN CASE WHEN v < 0 THEN '-' ELSE '' END || lpad(CAST(CAST(h AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(h AS BIGINT) AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(c // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c % 6000 // 100 AS VARCHAR), 2, '0')
    ELSE printf('%.7f', v) END AS shown FROM s""")
def number_formats(spark, sf_dir):
    """Balances in four forms; some round up to the next hour."""
    form = F.element_at(F.array(*[F.lit(f) for f in ("%9.1f", "%g", "%010.6m", "what")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.number_text(F.col("c_acctbal"), form).alias("shown"))


_VALUES = """WITH v AS (SELECT event_id, ['Num', 'Text', 'Switch', 'Light', 'Blob'][event_id % 5 + 1] AS kind, value - 50 AS num,
    CASE event_id % 15 // 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '1.5' ELSE 'true' END AS text, event_id % 2 = 0 AS switch FROM events)"""


@query(_VALUES + """ SELECT event_id, CASE kind WHEN 'Num' THEN CAST(trunc(num) AS INT) WHEN 'Text' THEN CASE WHEN regexp_full_match(text, '[0-9]+') THEN CAST(text AS INT) END WHEN 'Switch' THEN switch::INT END AS i,
    CASE kind WHEN 'Num' THEN num WHEN 'Text' THEN TRY_CAST(CASE WHEN text <> 'true' THEN text END AS DOUBLE) END AS d,
    CASE kind WHEN 'Switch' THEN switch WHEN 'Text' THEN CASE WHEN text = 'true' THEN true END END AS b,
    CASE kind WHEN 'Num' THEN printf('%.2f', num) WHEN 'Switch' THEN CASE WHEN switch THEN 'true' ELSE 'false' END WHEN 'Blob' THEN '[blob]' ELSE text END AS shown FROM v""")
def value_coercion(spark, sf_dir):
    v = table(spark, sf_dir, "events").selectExpr(
        "event_id", "element_at(array('Num', 'Text', 'Switch', 'Light', 'Blob'), cast(event_id % 5 + 1 as int)) AS kind", "value - 50 AS num",
        "CASE event_id % 15 div 5 WHEN 0 THEN cast(event_id as string) WHEN 1 THEN '1.5' ELSE 'true' END AS text", "event_id % 2 = 0 AS switch",
    )
    kind, num, t, switch = (F.col(c) for c in ("kind", "num", "text", "switch"))
    return v.select("event_id", dev.to_int(kind, num, t, switch).alias("i"), dev.to_double(kind, num, t).alias("d"), dev.to_flag(kind, t, switch).alias("b"), dev.to_text(kind, num, t, switch, F.lit("%.2f")).alias("shown"))


_UPDATES = """u AS (SELECT user_id AS device, event_type AS prop, CAST(event_id % 2 AS INT) AS elem, event_id AS seq, CAST(event_id % 3 AS INT) AS value, CASE WHEN event_id % 4 = 0 THEN 'Busy' ELSE 'Ok' END AS state, event_id % 11 = 0 AS deleted FROM events)"""


def _updates(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id AS device", "event_type AS prop", "cast(event_id % 2 as int) AS elem", "event_id AS seq", "cast(event_id % 3 as int) AS value", "CASE WHEN event_id % 4 = 0 THEN 'Busy' ELSE 'Ok' END AS state", "event_id % 11 = 0 AS deleted")


@query(f"""WITH {_UPDATES}, b AS (SELECT *, lag(seq) OVER w IS NULL OR lag(deleted) OVER w AS absent, lag(value) OVER w AS v0, lag(state) OVER w AS s0 FROM u WINDOW w AS (PARTITION BY device, prop, elem ORDER BY seq)),
  c AS (SELECT *, CASE WHEN deleted THEN CASE WHEN NOT absent THEN 'Delete' END WHEN absent THEN 'New' WHEN value <> v0 OR state <> s0 THEN 'Change' END AS change FROM b)
  SELECT device, prop, elem, seq AS change_id, change, CASE WHEN NOT deleted THEN value END AS value, CASE WHEN NOT deleted THEN state END AS state, CASE WHEN NOT absent THEN s0 END AS prev_state FROM c WHERE change IS NOT NULL""")
def change_events(spark, sf_dir):
    return dev.change_events(_updates(spark, sf_dir))


_ALIASES = [("shutter", 0, "purchase", ""), ("shutter", 1, "view", "1"), ("gain", 0, "click", "0"), ("gain", 1, "login", ""), ("gain", 2, "error", "1")]


@query(f"""WITH {_UPDATES}, a AS (SELECT * FROM (VALUES {', '.join(map(str, _ALIASES))}) t(purpose, pos, prop, elem)), h AS (SELECT DISTINCT device, prop, CAST(elem AS VARCHAR) AS elem FROM u),
  m AS (SELECT device, purpose, pos, a.prop, a.elem FROM h JOIN a ON a.prop = h.prop AND (a.elem = '' OR a.elem = h.elem))
  SELECT device, purpose, arg_min(prop, pos) AS prop, arg_min(elem, pos) AS elem FROM m GROUP BY ALL""")
def property_alias(spark, sf_dir):
    has = _updates(spark, sf_dir).withColumn("elem", F.col("elem").cast("string"))
    return dev.first_existing(has, spark.createDataFrame(_ALIASES, "purpose string, pos int, prop string, elem string"))


@query(f"""WITH {_UPDATES}, l AS (SELECT device, prop, elem, max(seq) AS change_id, arg_max(value, seq) AS value, arg_max(deleted, seq) AS deleted FROM u GROUP BY ALL)
  SELECT device, prop, elem, change_id, value FROM l WHERE NOT deleted AND change_id > 500""")
def properties_changed_after(spark, sf_dir):
    from ..operators.sessions import latest_properties

    u = _updates(spark, sf_dir).select("device", "prop", "elem", F.col("seq").alias("change_id"), F.when(F.col("deleted"), "Delete").otherwise("Change").alias("change"), "value")
    return dev.changed_after(latest_properties(u), 500)


#: A camera's name, made of a part's.
_CAMERA = "['ZWO ASI294MC Pro', 'SV405CC', 'ToupTek ATR2600C', 'asi6200mc', 'ASI178MC', 'Asi183mc-p', 'webcam', 'asi294mc asi178mc'][CAST(p_partkey % 8 AS INT) + 1]"


@query(f"""WITH t AS (SELECT * FROM (VALUES (0, ['asi294mc', 'sv405cc'], 'Sony IMX294', [1.255e0, 1.0e0, 1.607e0]), (1, ['atr3cmos26000kpa', 'touptek atr2600c'], 'Sony IMX571', [1.251e0, 1.0e0, 1.548e0]), (2, ['asi6200mc'], 'Sony IMX455', [1.225e0, 1.0e0, 1.526e0]),
    (3, ['asi178mc'], 'Sony IMX178', [1.332e0, 1.0e0, 1.572e0]), (4, ['asi183mc'], 'Sony IMX183', [1.293e0, 1.0e0, 1.574e0])) x(i, names, sensor, wb)),
  c AS (SELECT p_partkey, p_size, lower({_CAMERA}) AS cam FROM part),
  m AS (SELECT p_partkey, min(i) AS i FROM c, t WHERE list_bool_or(list_transform(names, lambda n: contains(cam, n))) GROUP BY p_partkey),
  w AS (SELECT c.p_partkey, sensor, CASE WHEN p_size % 4 = 0 THEN [2e0, 1.5e0, CAST(p_size AS DOUBLE)] ELSE coalesce(wb, [1e0, 1e0, 1e0]) END AS wb FROM c LEFT JOIN m USING (p_partkey) LEFT JOIN t USING (i))
  SELECT p_partkey, sensor, round(wb[1] / list_min(wb), 9) AS r, round(wb[2] / list_min(wb), 9) AS g, round(wb[3] / list_min(wb), 9) AS b FROM w""")
def camera_sensor(spark, sf_dir):
    names = ["ZWO ASI294MC Pro", "SV405CC", "ToupTek ATR2600C", "asi6200mc", "ASI178MC", "Asi183mc-p", "webcam", "asi294mc asi178mc"]
    camera = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int"))
    chosen = F.when(F.col("p_size") % 4 == 0, F.array(lit(2), lit(1.5), F.col("p_size").cast("double")))
    wb = cam.white_balance(chosen, camera)
    return table(spark, sf_dir, "part").select("p_partkey", cam.sensor(camera)[0].alias("sensor"), *[F.round(wb[k], 9).alias(c) for k, c in enumerate("rgb")])


@query("""WITH t AS (SELECT c_custkey, radians(15e0 * (c_custkey % 24)) AS ra1, radians(c_custkey % 160 - 80e0) AS dec1, radians(15e0 * (c_custkey % 24) + (c_custkey % 7) / 5e0) AS ra2, radians(c_custkey % 160 - 80e0 + (c_custkey % 5) / 4e0) AS dec2 FROM customer)
  SELECT c_custkey, degrees(2 * asin(least(1, sqrt(pow(sin((dec2 - dec1) / 2), 2) + cos(dec1) * cos(dec2) * pow(sin((ra2 - ra1) / 2), 2))))) <= 0.61e0 AS there FROM t""")
def telescope_on_target(spark, sf_dir):
    k = F.col("c_custkey")
    there = cam.on_target(k % 24, k % 160 - 80.0, F.radians(15.0 * (k % 24) + (k % 7) / 5.0), F.radians(k % 160 - 80.0 + (k % 5) / 4.0), lit(0.61))
    return table(spark, sf_dir, "customer").select("c_custkey", there.alias("there"))


@query("""WITH s AS (SELECT p_partkey, ['same', 'min', 'p25', 'p50', 'p75', 'max'][p_partkey % 6 + 1] AS level, ['none', 'p75', 'p50', 'p33', 'p25'][p_partkey % 5 + 1] AS crop, [1, 2, 4][p_partkey % 3 + 1] AS bin, p_size * 97 + 640 AS w FROM part)
  SELECT p_partkey, CASE level WHEN 'same' THEN p_partkey % 100 ELSE CASE level WHEN 'min' THEN 0e0 WHEN 'p25' THEN 0.25e0 WHEN 'p50' THEN 0.5e0 WHEN 'p75' THEN 0.75e0 ELSE 1e0 END * (570 - 10) + 10 END::DOUBLE AS gain,
    CAST(CASE crop WHEN 'none' THEN w WHEN 'p75' THEN 3 * w // 4 WHEN 'p50' THEN w // 2 WHEN 'p33' THEN w // 3 ELSE w // 4 END // bin AS BIGINT) AS width FROM s""")
def gain_and_crop(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % n + 1).cast("int"))
    gain = cam.gain_value(pick(["same", "min", "p25", "p50", "p75", "max"], 6), F.col("p_partkey") % 100, lit(10), lit(570))
    width = cam.active_size(F.col("p_size") * 97 + 640, pick(["none", "p75", "p50", "p33", "p25"], 5), pick([1, 2, 4], 3))
    return table(spark, sf_dir, "part").select("p_partkey", gain.alias("gain"), width.alias("width"))


@query("""WITH m AS (SELECT c_custkey, c_acctbal AS x, c_custkey % 13 AS y, c_custkey % 5 AS rx, c_custkey % 3 - 1 AS ry, c_custkey % 4 AS dx, c_custkey % 2 AS dy FROM customer)
  SELECT c_custkey, round((dy * x - dx * y) / nullif(dy * rx - dx * ry, 0), 6) + 0e0 AS ra_time, round((ry * x - rx * y) / nullif(ry * dx - rx * dy, 0), 6) + 0e0 AS dec_time FROM m""")
def mount_move(spark, sf_dir):
    k = F.col("c_custkey")
    ra, dec = cam.mount_move(F.col("c_acctbal"), k % 13, (k % 5, k % 3 - 1), (k % 4, k % 2))
    return table(spark, sf_dir, "customer").select("c_custkey", (F.round(ra, 6) + lit(0)).alias("ra_time"), (F.round(dec, 6) + lit(0)).alias("dec_time"))


@query("""WITH t AS (SELECT c_custkey, (c_custkey % 31 - 15) * 0.3e0 AS a, (c_custkey % 17 - 8) * 0.7e0 AS b FROM customer)
  SELECT c_custkey, sign(a) * least(ceil(abs(a) / 0.25 - 0.5), 12) * 0.25 + 0e0 AS x, sign(b) * least(ceil(abs(b) / 0.25 - 0.5), 12) * 0.25 + 0e0 AS y FROM t""")
def coordinate_descent(spark, sf_dir):
    """From the origin to the nearest point of a grid in a bowl, in at most twelve rounds."""
    k = F.col("c_custkey")
    a, b = (k % 31 - 15) * 0.3, (k % 17 - 8) * 0.7
    at = cam.descend(F.array(lit(0), lit(0)), 0.25, 12, lambda p: (p[0] - a) ** 2 + (p[1] - b) ** 2)
    # few bytes make much work, so Spark's shares of a file are too large
    c = table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return c.select("c_custkey", at.alias("p")).select("c_custkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("""WITH r AS (SELECT event_type, min(epoch(ts)) AS min_x, max(epoch(ts)) AS max_x, min(value) AS min_y, max(value) AS max_y FROM events GROUP BY event_type),
  k AS (SELECT *, pow(10e0, round(log10(max_y - min_y))) / 10 AS mul FROM r WHERE max_y > min_y),
  c AS (SELECT event_type, min_x, max_x, min_y, max_y, list_filter([mul * 0.2, mul * 0.25, mul * 0.4, mul * 0.5, mul, mul * 2, mul * 2.5, mul * 4, mul * 5, mul * 10], lambda v: (max_y - min_y) / v < 8)[1] AS step FROM k)
  SELECT event_type, CAST(round(min_x) AS BIGINT) AS min_x, CAST(round(max_x) AS BIGINT) AS max_x, min_y, max_y, round(step, 9) AS step FROM c""")
def plot_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    r = e.groupBy("event_type").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("value").alias("min_y"), F.max("value").alias("max_y")).where("max_y > min_y")
    return r.withColumn("step", F.round(cam.axis_step(F.col("max_y") - F.col("min_y"), lit(8)), 9))


@query("""WITH f AS (SELECT p_partkey, ['light', 'flat', 'dark', 'bias'][p_partkey % 4 + 1] AS kind, 640 + p_partkey % 2 AS w, CASE WHEN p_partkey % 3 > 0 THEN 'RGGB' END AS cfa FROM part)
  SELECT p_partkey, CASE WHEN kind NOT IN ('dark', 'bias') THEN 'type' WHEN w <> 640 THEN 'size' WHEN cfa IS NULL THEN 'pattern' END AS problem FROM f""")
def master_compatibility(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("light", "flat", "dark", "bias"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    cfa = F.when(F.col("p_partkey") % 3 > 0, "RGGB")
    problem = cal.compatible(F.lit("light"), F.lit(640), F.lit(480), F.lit("RGGB"), ["dark", "bias"], kind, 640 + F.col("p_partkey") % 2, F.lit(480), cfa)
    return table(spark, sf_dir, "part").select("p_partkey", problem.alias("problem"))


_SCALES = ["fit", "original", "p75", "p50", "p33", "p25", "p15", "p10", "p5", "corners"]


@query(f"""WITH s AS (SELECT p_partkey, {_SCALES}[p_partkey % 10 + 1] AS scale, 300 + p_size * 61 AS w, 200 + p_size * 37 + p_partkey % 900 AS h, 640 AS aw, 30 + p_partkey % 480 AS ah FROM part),
  n AS (SELECT *, CASE scale WHEN 'p75' THEN 3 WHEN 'p15' THEN 15 WHEN 'p10' THEN 10 WHEN 'p5' THEN 5 ELSE 1 END AS a, CASE scale WHEN 'p75' THEN 4 WHEN 'p50' THEN 2 WHEN 'p33' THEN 3 WHEN 'p25' THEN 4 WHEN 'p15' THEN 100 WHEN 'p10' THEN 100 WHEN 'p5' THEN 100 ELSE 1 END AS b FROM s)
  SELECT p_partkey, CAST(CASE scale WHEN 'fit' THEN CASE WHEN w::DOUBLE / h > aw::DOUBLE / ah THEN aw ELSE floor(ah * (w::DOUBLE / h)) END WHEN 'corners' THEN greatest(42, least(aw, ah)) ELSE a * w // b END AS BIGINT) AS width,
    CAST(CASE scale WHEN 'fit' THEN CASE WHEN w::DOUBLE / h > aw::DOUBLE / ah THEN floor(aw / (w::DOUBLE / h)) ELSE ah END WHEN 'corners' THEN greatest(42, least(aw, ah)) ELSE a * h // b END AS BIGINT) AS height,
    CAST(CASE scale WHEN 'fit' THEN CASE WHEN w // 4 > aw AND h // 4 > ah THEN 4 WHEN w // 3 > aw AND h // 3 > ah THEN 3 WHEN w // 2 > aw AND h // 2 > ah THEN 2 ELSE 1 END
      WHEN 'p50' THEN 2 WHEN 'p33' THEN 3 WHEN 'p25' THEN 4 WHEN 'p15' THEN 4 WHEN 'p10' THEN 4 WHEN 'p5' THEN 4 ELSE 1 END AS INT) AS reduction FROM n""")
def preview_sizes(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    scale = F.element_at(F.array(*map(F.lit, _SCALES)), (k % 10 + 1).cast("int"))
    of = (scale, 300 + s * 61, 200 + s * 37 + k % 900, F.lit(640), 30 + k % 480)
    w, h = cam.preview_size(*of)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), cam.reduction(*of).alias("reduction"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'flat' WHEN '2-HIGH' THEN 'dark' ELSE 'light' END AS kind, CASE WHEN o_orderkey % 5 < 4 THEN ['RGGB', 'BGGR', 'GRBG', 'GBRG'][o_orderkey % 5 + 1] END AS pattern FROM orders""")
def typed_codes(spark, sf_dir):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "Flat").when(F.col("o_orderpriority") == "2-HIGH", cam.frame_type_name(F.lit("dark"))).otherwise(F.col("o_orderpriority"))
    pattern = F.element_at(F.array(*map(F.lit, ("RGGB", "BGGR", "GRBG", "GBRG", "mono"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cam.frame_type(name, F.lit("light")).alias("kind"), cam.cfa_pattern(pattern).alias("pattern"))
