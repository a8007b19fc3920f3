"""Text sources and sinks: defect lists, catalogues, constellations, device lists, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import name_tokens, parse_sexagesimal


def read_bad_pixels(spark: SparkSession, path: str) -> DataFrame:
    return bad_pixels_of(spark.read.text(path))


def bad_pixels_of(lines: DataFrame) -> DataFrame:
    """(x, y) of lines (value) with two whole numbers; other lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.select(F.get(p, F.lit(0)).try_cast("int").alias("x"), F.get(p, F.lit(1)).try_cast("int").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def write_bad_pixels(pixels: DataFrame, path: str) -> None:
    pixels.select(F.concat_ws(" ", "x", "y").alias("value")).write.text(path)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, sep=";", header=True)
    return d.toDF(*[c.strip().lower() for c in d.columns])


def _angle(c: str, hours: bool) -> Column:
    v = F.coalesce(parse_sexagesimal(F.col(c)), F.col(c).try_cast("double"))
    return F.radians(v * 15 if hours else v)


def read_dsos(spark: SparkSession, path: str) -> DataFrame:
    return dsos_of(_csv(spark, path))


def dsos_of(d: DataFrame) -> DataFrame:
    """Deep-sky objects of a ;-separated file's columns, all text; names and nicknames are |-separated, rows without a place are left out."""
    many = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.transform(many("names"), lambda n: F.struct(n.alias("orig"), F.lower(n).alias("lc"), name_tokens(n).alias("parts")))
    nick = F.transform(many("nicknames"), lambda n: F.struct(n.alias("orig"), F.lower(n).alias("lc")))
    number = lambda c: F.col(c).try_cast("double")
    out = d.select(
        "type", _angle("ra", True).alias("ra"), _angle("dec", False).alias("dec"), "constellation", names.alias("names"), nick.alias("nicknames"),
        number("mag_v").alias("mag_v"), number("mag_b").alias("mag_b"), number("major_axis").alias("major_axis"), number("minor_axis").alias("minor_axis"), number("angle").alias("angle"),
    )
    return out.where("ra IS NOT NULL AND dec IS NOT NULL")


def read_named_stars(spark: SparkSession, path: str) -> DataFrame:
    return named_stars_of(_csv(spark, path))


def named_stars_of(d: DataFrame) -> DataFrame:
    """Named stars of a ;-separated file's columns, all text; rows without a place are left out."""
    out = d.select("name", F.lower("name").alias("name_lc"), "bayer", F.lower("bayer").alias("bayer_lc"), _angle("ra", True).alias("ra"), _angle("dec", False).alias("dec"), "constellation", F.col("mag").try_cast("double").alias("mag"), F.coalesce(F.col("bv").try_cast("double"), F.lit(0.0)).alias("bv"))
    return out.where("ra IS NOT NULL AND dec IS NOT NULL")


def read_constellations(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, kind, parts ARRAY<ARRAY<STRUCT<ra,dec>>>) of a GeoJSON file of lines or polygons, in degrees."""
    point = "array<double>"
    schema = "features array<struct<id: string, properties: struct<id: string, name: string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    g = f.select(F.coalesce("f.properties.id", "f.id").alias("id"), "f.properties.name", "f.geometry.type", "f.geometry.coordinates")
    lines = F.from_json("coordinates", f"array<array<{point}>>")
    shapes = F.flatten(F.from_json("coordinates", f"array<array<array<{point}>>>"))
    parts = F.when(F.col("type") == "MultiPolygon", shapes).otherwise(lines)
    turned = F.transform(parts, lambda line: F.transform(line, lambda p: F.struct(F.radians(F.pmod(p[0] + 360, F.lit(360.0))).alias("ra"), F.radians(p[1]).alias("dec"))))
    return g.select("id", "name", F.when(F.col("type") == "MultiPolygon", "bounds").otherwise("lines").alias("kind"), turned.alias("parts"))


def read_drivers(spark: SparkSession, path: str) -> DataFrame:
    """(group, devices): devices of XML files, those of a group together, sorted by maker and name in lower case."""
    d = spark.read.format("xml").option("rowTag", "devGroup").schema("_group string, device array<struct<_label: string, _manufacturer: string, driver: struct<_VALUE: string, _name: string>>>").load(path)
    one = d.select(F.col("_group").alias("group"), F.explode("device").alias("d"))
    return driver_groups(one.select("group", F.col("d._manufacturer").alias("maker"), F.col("d._label").alias("label"), F.col("d.driver._VALUE").alias("driver")))


def driver_groups(drivers: DataFrame) -> DataFrame:
    """(group, devices) of rows (group, maker, label, driver) of any number of files."""
    entry = F.struct(F.lower(F.coalesce("maker", F.lit(""))).alias("by"), F.lower("label").alias("label_lc"), "label", "driver")
    return drivers.groupBy("group").agg(F.array_sort(F.collect_list(entry)).alias("devices"))


def read_settings(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """Settings of a JSON file under a schema, with defaults for keys that are missing."""
    return with_defaults(spark.read.schema(schema).json(path, multiLine=True), defaults)


def with_defaults(d: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return d.select(*[F.coalesce(F.col(c), F.lit(defaults.get(c))).alias(c) for c in d.columns])


def decode_base64(c: Column) -> Column:
    """Bytes of base64 text; characters outside the alphabet are ignored."""
    return F.unbase64(F.regexp_replace(c, "[^A-Za-z0-9+/]", ""))


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (name) with `free`: the name itself where it doesn't exist, else with the first of _2, _3, ... before its ending that doesn't.

    Names that are wanted count as taken, too, and rows that want the same name get different ones.
    """
    ending = lambda c: F.regexp_extract(c, r"^.+(\.[^.]*)$", 1)
    stem = lambda c: F.regexp_replace(c, r"^(.+)\.[^.]*$", "$1")
    number = F.regexp_extract(stem("name"), r"_([1-9]\d*)$", 1).try_cast("int")
    there = existing.select("name").distinct().withColumn("_there", F.lit(True))
    e = existing.select("name").unionByName(wanted.select("name")).distinct().select("name", F.regexp_replace(stem("name"), r"_[1-9]\d*$", "").alias("_stem"), ending("name").alias("_end"), number.alias("_n"))
    taken = e.where("_n IS NOT NULL").groupBy("_stem", "_end").agg(F.collect_set("_n").alias("_taken"))
    w = wanted.withColumn("_stem", stem("name")).withColumn("_end", ending("name"))
    w = w.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(*wanted.columns)))
    w = w.join(there, "name", "left").join(taken, ["_stem", "_end"], "left")
    used = F.coalesce("_taken", F.array().cast("array<int>"))
    # of rows that want the same name the first may have it, if it is free; the others get one number after another
    which = F.col("_r") - F.when(F.col("_there"), 1).otherwise(2)
    n = F.get(F.filter(F.sequence(F.lit(2), F.size(used) + F.col("_r") + 2), lambda k: ~F.array_contains(used, k)), which)
    free = F.when(which >= 0, F.concat("_stem", F.lit("_"), n.cast("string"), "_end")).otherwise(F.col("name"))
    return w.select(*wanted.columns, free.alias("free"))


_ELEMENT = "array<struct<_VALUE: string, _name: string, _label: string, _format: string, _min: string, _max: string, _step: string>>"
_CHILDREN = [f"{verb}{kind}" for verb in ("def", "one") for kind in ("Text", "Number", "Switch", "Light", "BLOB")]


def device_properties(messages: DataFrame, column: str = "value") -> DataFrame:
    """(message columns, verb, kind, device, prop, elem, num, text, switch, state, label, form) of a device protocol's vectors, a row an element.

    verb: "def" for a definition, "set" for an update, "new" for a wish. kind as operators.devices has it. A switch is on where its
    text says so in any case. A number that can't be read is null; what is no vector gives no row.
    """
    head = r"^\s*<(def|set|new)(Text|Number|Switch|Light|BLOB)Vector"
    schema = "_device string, _name string, _state string, " + ", ".join(f"{c} {_ELEMENT}" for c in _CHILDREN)
    m = messages.withColumn("_verb", F.regexp_extract(column, head, 1)).where("_verb <> ''").withColumn("_kind", F.regexp_extract(column, head, 2)).withColumn("_x", F.from_xml(F.col(column), schema))
    child = F.lit(None).cast(_ELEMENT)
    for kind in ("Text", "Number", "Switch", "Light", "BLOB"):
        child = F.when(F.col("_kind") == kind, F.when(F.col("_verb") == "def", F.col(f"_x.def{kind}")).otherwise(F.col(f"_x.one{kind}"))).otherwise(child)
    e = m.select(*messages.columns, "_verb", "_kind", "_x", F.explode(child).alias("_e"))
    value = F.trim(F.coalesce("_e._VALUE", F.lit("")))
    kind = F.when(F.col("_kind") == "Number", "Num").when(F.col("_kind") == "BLOB", "Blob").otherwise(F.col("_kind"))
    return e.select(
        *messages.columns, F.col("_verb").alias("verb"), kind.alias("kind"), F.col("_x._device").alias("device"), F.col("_x._name").alias("prop"), F.col("_e._name").alias("elem"),
        F.when(F.col("_kind") == "Number", value.try_cast("double")).alias("num"), F.when(F.col("_kind").isin("Text", "Light"), value).alias("text"),
        F.when(F.col("_kind") == "Switch", F.lower(value) == "on").alias("switch"), F.col("_x._state").alias("state"), F.col("_e._label").alias("label"), F.col("_e._format").alias("form"),
    )
