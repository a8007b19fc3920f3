"""Row numbers and the row before, without a window over all rows of a key.

Rows are dealt into spans, ranges of the order of about equal counts, whose number grows with the table. A
window numbers each span; one row a span says what lies before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key in one span, about.
SPAN = 1 << 18


def place_of(rows: DataFrame, order: str) -> Column:
    """A number or a time as a double that rises with it."""
    if rows.schema[order].dataType.typeName() != "timestamp_ntz":
        return F.col(order).cast("double")
    since = f"({order} - timestamp_ntz'1970-01-01 00:00:00')"  # without a zone there is no cast, and a zone's clock may go back
    return F.expr(" + ".join(f"cast(extract({unit} FROM {since}) AS double) * {n}" for unit, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))))


def dealt(rows: DataFrame, order: str, key: str | None = None, span: int = SPAN) -> DataFrame:
    """rows with `_key` and `_span`: ranges of `order` (a number or a time, nulls before all) of about `span` rows of a key, rising with it.

    Only keys of more than `span` rows are divided, so what the driver sees of them is a share of the rows. The spans are a
    monotone function of the order: where exactly they part changes no result, but rows of one place stay together.
    """
    keyed = rows.withColumn("_key", F.lit(0) if key is None else F.col(key))
    place = place_of(rows, order)
    large = keyed.groupBy("_key").count().where(F.col("count") > span).collect()
    if not large:
        return keyed.withColumn("_span", F.lit(0))
    parts = -(-max(r["count"] for r in large) // span)
    at = [i / parts for i in range(1, parts)]
    found = keyed.groupBy("_key").agg(F.percentile_approx(place, at, max(10_000, 20 * parts)).alias("at"), F.count("*").alias("n")).where(F.col("n") > span).select("_key", "at").collect()
    bounds = {r["_key"]: np.array(r["at"] or []) for r in found}

    @F.pandas_udf("int")
    def span_of(k: pd.Series, p: pd.Series) -> pd.Series:
        out = np.zeros(len(k), np.int32)
        for one, where in k.groupby(k, dropna=False).indices.items():
            cuts = bounds.get(None if pd.isna(one) else one)
            if cuts is not None:
                out[where] = np.searchsorted(cuts, p.to_numpy()[where], side="left")
        return pd.Series(out)

    return keyed.withColumn("_span", F.when(place.isNull(), -1).otherwise(span_of("_key", place)))


def ahead_of(ends: DataFrame, sums: list[str]) -> DataFrame:
    """(_ek, _es, sums): for each row (_key, _span, sums) the sums of the key's spans before it. A row a span."""
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(F.col("_key").alias("_ek"), F.col("_span").alias("_es"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])


def running(rows: DataFrame, order: str, ties: tuple[str, ...], key: str, sums: dict[str, Column], span: int = SPAN) -> DataFrame:
    """rows with running sums by (order, ties) in each key, nulls first; a null adds nothing.

    Spans are summed side by side, and each starts from the sums of those before it: no task holds a key.
    """
    d = dealt(rows, order, key, span)
    for name, c in sums.items():
        d = d.withColumn(f"_v_{name}", c)
    ends = d.groupBy("_key", "_span").agg(*[F.sum(f"_v_{name}").alias(name) for name in sums])
    inside = Window.partitionBy("_key", "_span").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)).alias(f"_s_{name}") for name in sums])
    d = d.join(ahead_of(ends, list(sums)), F.col("_key").eqNullSafe(F.col("_ek")) & (F.col("_span") == F.col("_es")))
    return d.select(*rows.columns, *[(F.col(f"_s_{name}") + F.col(f"_{name}")).alias(name) for name in sums])


def numbered(rows: DataFrame, order: str, key: str | None = None, carry: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """rows with `_k`, the number of each from 1 by `order` (a number, nulls first) in its key, and `_before`, a struct of `carry` of the row before."""
    keyed = dealt(rows, order, key, span)
    ends = keyed.groupBy("_key", "_span").agg(F.count("*").alias("_rows"), F.max(F.struct(order, *carry)).alias("_last"))
    along = Window.partitionBy("_key").orderBy("_span")
    ahead = F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("_key").alias("_ek"), F.col("_span").alias("_es"), ahead.alias("_ahead"), F.lag("_last").over(along).alias("_end"))
    inside = Window.partitionBy("_key", "_span").orderBy(order)
    out = keyed.withColumn("_i", F.row_number().over(inside)).withColumn("_lag", F.lag(F.struct(order, *carry)).over(inside))
    out = out.join(ends, F.col("_key").eqNullSafe(F.col("_ek")) & (F.col("_span") == F.col("_es")))
    out = out.withColumn("_k", F.col("_i") + F.col("_ahead")).withColumn("_before", F.when(F.col("_i") == 1, F.col("_end")).otherwise(F.col("_lag")))
    return out.drop("_key", "_span", "_ek", "_es", "_ahead", "_end", "_i", "_lag")
