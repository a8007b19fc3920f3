"""Sky catalogues: union of sources, nearest objects, ranked search by name, visibility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.numeric import circular_mean
from ..functions.text import name_tokens
from .cuts import cut


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of all sources (name, ra, dec, ...)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_constellations(objects: DataFrame, constellations: DataFrame) -> DataFrame:
    """Objects with the id of their constellation's abbreviation; 0 for one that is not known."""
    joined = objects.join(constellations.select(F.col("abbrev").alias("constellation"), "cnst_id"), "constellation", "left")
    return joined.withColumn("cnst_id", F.coalesce("cnst_id", F.lit(0)))


def any_magnitude(v: str = "mag_v", b: str = "mag_b") -> Column:
    return F.coalesce(F.col(v), F.col(b))


def colour_index(v: str = "mag_v", b: str = "mag_b") -> Column:
    """B - V, where both are known."""
    return F.col(b) - F.col(v)


def night_altitudes(objects: DataFrame, times: DataFrame, longitude: float, latitude: float, limit: float = -math.pi / 10) -> DataFrame:
    """objects (name, ra, dec) with `low` and `high`, their least and greatest altitude while the sun is below `limit`; null where it never is.

    times (ts): a series of points of time, few: their sidereal times travel in one array.
    """
    where = (sky.lit(longitude), sky.lit(latitude))
    jd = sky.julian_time(F.col("ts"))
    sun = sky.altitude(*sky.sun(sky.centuries(jd)), sky.sidereal_time(jd), *where)
    night = times.where(sun < limit).agg(F.collect_list(sky.sidereal_time(jd)).alias("_nights"))
    alt = F.transform("_nights", lambda s: sky.altitude(F.col("ra"), F.col("dec"), s, *where))
    return objects.crossJoin(F.broadcast(night)).select(*objects.columns, F.array_min(alt).alias("low"), F.array_max(alt).alias("high"))  # one row


#: Objects in a cell, about, when the search for the nearest begins.
CELL_OBJECTS = 16


def nearest(probes: DataFrame, stars: DataFrame, dsos: DataFrame, max_mag: float) -> DataFrame:
    """For each probe (probe_id, ra, dec) its nearest object: kind, name, angle.

    stars (name, ra, dec, mag, named): magnitude below max_mag; deep-sky objects (name, ra, dec, mag): at most
    max_mag, without a magnitude never. Ties: a deep-sky object before a star, a named star before another.

    Objects and probes are dealt into cubes of space that hold about CELL_OBJECTS of them; a probe meets those of its cube
    and of the 26 around it. If the best is not farther than a cube's side, nothing nearer can lie elsewhere and the probe is
    settled; the others go on with sides twice as long, until a cube holds the sky.
    """
    s = stars.where(F.col("mag") < max_mag).select("name", "ra", "dec", F.when(F.col("named"), 1).otherwise(2).alias("tie"))
    d = dsos.where(F.col("mag") <= max_mag).select("name", "ra", "dec", F.lit(0).alias("tie"))
    every = s.unionByName(d).where(F.col("ra").isNotNull() & F.col("dec").isNotNull())
    left = cut(probes.select("probe_id", F.col("ra").alias("pra"), F.col("dec").alias("pdec")))
    side = min(2.0, (4 * 3.2 * CELL_OBJECTS / max(every.count(), 1)) ** 0.5)
    found = []
    while True:
        key = lambda ra, dec: [F.floor(x / side).cast("int") for x in sky.to_vector(F.col(ra), F.col(dec))]  # noqa: B023, E731
        o = every.select("*", *[k.alias(c) for k, c in zip(key("ra", "dec"), "xyz", strict=True)])
        p = left.select("*", *[k.alias(c) for k, c in zip(key("pra", "pdec"), "xyz", strict=True)])
        for c in "xyz":
            p = p.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
        angle = F.round(sky.angle_between(F.col("ra"), F.col("dec"), F.col("pra"), F.col("pdec")), 9)
        best = o.join(p, ["x", "y", "z"]).select("probe_id", F.struct(angle.alias("angle"), "tie", "name").alias("o")).groupBy("probe_id").agg(F.min("o").alias("o"))
        if side < 2:
            best = best.where(2 * F.sin(F.col("o.angle") / 2) <= side * 0.999)
        found.append(cut(best))
        if side >= 2:
            break
        left = cut(left.join(found[-1], "probe_id", "left_anti"))
        if left.isEmpty():
            break
        side = min(2.0, 2 * side)
    best = merge(*found)
    kind = F.when(F.col("o.tie") == 0, "dso").when(F.col("o.tie") == 1, "named star").otherwise("star")
    return best.select("probe_id", kind.alias("kind"), "o.name", "o.angle")


def nearest_dso(probes: DataFrame, dsos: DataFrame, max_mag: float, wanted: Column | None = None) -> DataFrame:
    """As nearest(), of those deep-sky objects for which `wanted`, such as a condition on their type, holds."""
    some = dsos if wanted is None else dsos.where(wanted)
    no_stars = some.select("name", "ra", "dec", "mag", F.lit(False).alias("named")).limit(0)
    return nearest(probes, no_stars, some, max_mag)


def search(text: str, constellations: DataFrame, dsos: DataFrame, stars: DataFrame) -> DataFrame:
    """(stage, kind, name) of what matches: nine stages, equal, begins and contains, each of constellations, objects, stars.

    A name found in two stages is in the first only. Objects are equal also if the parts of their names are;
    for constellations alone, what is equal also begins.
    """
    want = text.strip().lower()
    if not want:
        return constellations.select(F.lit(0).alias("stage"), F.lit("").alias("kind"), "name").limit(0)
    parts = name_tokens(F.lit(want))
    found = []
    for k, (kind, rows) in enumerate((("constellation", constellations), ("dso", dsos), ("star", stars))):
        lc = F.lower("name")
        equal = (lc == want) | ((name_tokens(F.col("name")) == parts) if kind == "dso" else F.lit(False))
        begins, contains = lc.startswith(want), lc.contains(want)
        stage = F.when(equal, k).when(begins, 3 + k).when(contains, 6 + k)
        found.append(rows.select(stage.alias("stage"), F.lit(kind).alias("kind"), "name").where("stage IS NOT NULL"))
    every = merge(*found)
    first = Window.partitionBy("name").orderBy("stage", "kind")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("stage", "kind", "name")


def constellation_centres(points: DataFrame) -> DataFrame:
    """(name, ra, dec): the circular means of the points (name, ra, dec) of a constellation's lines; ra in 0 to 2 pi."""
    c = points.groupBy("name").agg(circular_mean(F.col("ra")).alias("ra"), circular_mean(F.col("dec")).alias("dec"))
    return c.withColumn("ra", F.when(F.col("ra") < 0, F.col("ra") + sky.PI2).otherwise(F.col("ra")))


def search_objects(text: str, points: DataFrame, dsos: DataFrame, stars: DataFrame, above: Column) -> DataFrame:
    """(stage, kind, name, ra, dec, above) of what matches, for orderBy(above desc, stage): what stands above the horizon comes first.

    points (name, ra, dec): of the lines of constellations, which are found by name and stand at their centres. dsos (names
    array, nicknames array, ra, dec): a name or nickname matches; a name is equal also if its parts are. stars (name, bayer, ra,
    dec): the name or the designation matches. Stages as in search(); objects of the same names are in the first only.
    above: a condition on ra and dec.
    """
    want = text.strip().lower()
    parts = name_tokens(F.lit(want))

    def stages(low: Column, equal: Column, k: int, keep_equal: bool = False) -> Column:
        begins = low.startswith(want)
        return F.array_compact(F.array(F.when(equal, k), F.when(begins & (F.lit(keep_equal) | (low != want)), 3 + k), F.when(low.contains(want) & ~begins, 6 + k)))

    def named(names: Column, tokens: bool, k: int) -> Column:
        """The first stage of any of the names."""
        same = lambda n: (F.lower(n) == want) | ((name_tokens(n) == parts) if tokens else F.lit(False))
        return F.array_min(F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: stages(F.lower(n), same(n), k))))

    c = constellation_centres(points).select(F.array_min(stages(F.lower("name"), F.lower("name") == want, 0, True)).alias("stage"), F.lit("constellation").alias("kind"), "name", "ra", "dec")
    joined = F.array_join(F.col("names"), "|")
    d = dsos.select(F.least(named(F.col("names"), True, 1), named(F.col("nicknames"), False, 1)).alias("stage"), F.lit("dso").alias("kind"), joined.alias("name"), "ra", "dec")
    n = stars.select(named(F.array_compact(F.array("name", "bayer")), False, 2).alias("stage"), F.lit("star").alias("kind"), "name", "ra", "dec")
    every = merge(c, d, n).where(F.col("stage").isNotNull() & F.lit(bool(want)))
    first = every.groupBy("name").agg(F.min(F.struct("stage", "kind", "ra", "dec")).alias("o"))
    return first.select("o.stage", "o.kind", "name", "o.ra", "o.dec").withColumn("above", above)


def visible_zones(objects: DataFrame, sidereal: Column, longitude: float, latitude: float, n: int = 40, centre: tuple[float, float] | None = None) -> DataFrame:
    """Objects in zones of an n x n grid with a corner above the horizon, or in that of the view's centre (ra, dec): a semi join with the 1,600 zones.

    Written by zone, a catalogue is pruned by it before any object is read.
    """
    spark = objects.sparkSession
    z = spark.range(n * n).select((F.col("id") % n).cast("int").alias("ra_key"), F.expr(f"cast(id div {n} as int)").alias("dec_key"))
    up = F.lit(False)
    for i in (0, 1):
        for j in (0, 1):
            ra = (F.col("ra_key") + i) * (2 * math.pi / n)
            dec = (F.col("dec_key") + j) * (math.pi / n) - math.pi / 2
            up = up | (sky.to_horizon(ra, dec, sidereal, sky.lit(longitude), sky.lit(latitude))[0] > 0)
    ra_key, dec_key = sky.zone(F.col("ra"), F.col("dec"), n)
    if centre is not None:
        mid = sky.zone(sky.lit(centre[0]), sky.lit(centre[1]), n)
        up = up | ((F.col("ra_key") == mid[0]) & (F.col("dec_key") == mid[1]))
    keyed = objects.withColumn("ra_key", ra_key).withColumn("dec_key", dec_key)
    return keyed.join(F.broadcast(z.where(up)), ["ra_key", "dec_key"], "left_semi")


def outlines(lines: DataFrame, file: str | None = None) -> DataFrame:
    """Polygons from ordered text lines (n, line): "ra dec start name", "ra dec vertex", "ra dec end".

    A running count of starts is the outline's number. `file`: the column that says which file a line is of; files are
    numbered apart and by different tasks.
    """
    p = F.split(F.trim("line"), r"\s+")
    of = F.lit("") if file is None else F.col(file)
    rows = lines.select(of.alias("_file"), "n", F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b"), F.get(p, F.lit(2)).alias("what"), F.array_join(F.slice(p, 4, 1000), " ").alias("name"))
    rows = rows.where(F.col("what").isin("start", "vertex", "end"))
    number = F.sum((F.col("what") == "start").cast("int")).over(Window.partitionBy("_file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    point = F.struct("n", F.radians(F.col("a").try_cast("double") * 15).alias("ra"), F.radians(F.col("b").try_cast("double") * 15).alias("dec"))
    made = rows.withColumn("outline", number).where("outline > 0").groupBy("_file", "outline").agg(F.max(F.when(F.col("what") == "start", F.col("name"))).alias("name"), F.array_sort(F.collect_list(point)).alias("points"))
    also = [] if file is None else [F.col("_file").alias(file)]
    return made.select(*also, "outline", "name", F.transform("points", lambda x: F.struct(x["ra"].alias("ra"), x["dec"].alias("dec"))).alias("polygon"))
