"""Properties of devices: coercion of values, lookup, and what each update changes.

A property's value is a struct-like row: kind ("Num", "Text", "Switch", "Light", "Blob"), num, text, switch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_text

KINDS = ["Num", "Text", "Switch", "Light", "Blob"]
KEY = ["device", "prop", "elem"]


def to_int(kind: Column, num: Column, text: Column, switch: Column) -> Column:
    """Numbers cut toward zero and held within 32 bits, whole texts, switches as 0 and 1; null for what can't be converted."""
    held = F.greatest(F.least(F.nanvl(num, F.lit(0.0)), F.lit(2147483647.0)), F.lit(-2147483648.0))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    return F.when(kind == "Num", held.cast("int")).when(kind == "Text", whole).when(kind == "Switch", switch.cast("int"))


def to_double(kind: Column, num: Column, text: Column) -> Column:
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(kind == "Num", num).when(kind == "Text", number)


def to_flag(kind: Column, text: Column, switch: Column) -> Column:
    return F.when(kind == "Switch", switch).when((kind == "Text") & text.isin("true", "false"), text == "true")


def to_text(kind: Column, num: Column, text: Column, switch: Column, form: Column) -> Column:
    """What is shown of a value; numbers in their property's form."""
    return F.when(kind == "Num", number_text(num, form)).when(kind.isin("Text", "Light"), text).when(kind == "Switch", switch.cast("string")).when(kind == "Blob", "[blob]")


def changed_after(latest: DataFrame, change_id: int | None) -> DataFrame:
    """Properties (device, prop, elem, change_id, ...) changed after a number; all of them for None. Written by change_id, files are skipped by it."""
    return latest if change_id is None else latest.where(F.col("change_id") > change_id)


def first_existing(latest: DataFrame, aliases: DataFrame) -> DataFrame:
    """(device, purpose, prop, elem): for each device and purpose the first alias (purpose, pos, prop, elem) that the device has.

    An alias without an element ("" or null) is met by any element of its property.
    """
    has = latest.select("device", "prop", "elem").distinct()
    a = aliases.select("purpose", "pos", "prop", F.nullif(F.col("elem"), F.lit("")).alias("wanted"))
    met = has.join(a, "prop").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("elem")))
    best = met.groupBy("device", "purpose").agg(F.min(F.struct("pos", "prop", F.coalesce("wanted", F.lit("")).alias("elem"))).alias("a"))
    return best.select("device", "purpose", "a.prop", "a.elem")


def change_events(updates: DataFrame) -> DataFrame:
    """(device, prop, elem, change_id, change, value, state, prev_state) of updates (device, prop, elem, seq, value, state, deleted) in the order of seq.

    The first value of an element, or the first after its property was deleted, is "New"; one that differs from the
    value or the state before is "Change", and an equal one is no event; a deletion of what there is is "Delete".
    change_id is the update's number.
    """
    order = Window.partitionBy(*KEY).orderBy("seq")
    before = F.lag(F.struct("value", "state", "deleted")).over(order)
    u = updates.withColumn("_b", before)
    absent = F.col("_b").isNull() | F.col("_b.deleted")
    same = F.col("value").eqNullSafe(F.col("_b.value")) & F.col("state").eqNullSafe(F.col("_b.state"))
    change = F.when(F.col("deleted"), F.when(~absent, "Delete")).when(absent, "New").when(~same, "Change")
    kept = lambda c: F.when(~F.col("deleted"), F.col(c))
    out = u.select(*KEY, F.col("seq").alias("change_id"), change.alias("change"), kept("value").alias("value"), kept("state").alias("state"), F.when(~absent, F.col("_b.state")).alias("prev_state"))
    return out.where("change IS NOT NULL")


def shots_with_masters(shots: DataFrame, masters: DataFrame) -> DataFrame:
    """Shots, batch or stream, with the master of their key (null without one). masters (key, master) is read as it stands."""
    return shots.join(masters, "key", "left")
