"""What each filter of a chain removes, hides and costs, for every order in which the chain can be applied.

Documents become failure masks, one bit a filter, and are counted by part and mask at once: from there on the work is on at
most 2^filters cells a part, however many documents there are. Each cell is unpivoted against the steps of all orders; a
running bit-or over the earlier steps of an order says whether an earlier filter fails, conditional sums give each step's
numbers, and a window over a filter's rows in all orders gives its total.

Masks of the five filters of `documents` are expressions of the text alone but for the copies: the least id of each digest
that more than one id holds is joined back by digest.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, written

LETTERS = "ABCDE"
SPACES = " \t\n\x0b\f\r"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failing(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with a boolean column fails_A to fails_D for each filter of the text (not null) by itself.

    Words are maximal runs without 0x20 and 0x09-0x0D, told apart by case; they are split once for both A and B.
    """
    trimmed = F.btrim(F.col(text_col), F.lit(SPACES))
    d = docs.withColumn("_w", F.split(trimmed, WHITE)).withColumn("_capitals", F.regexp_count(F.col(text_col), F.lit("[A-Z]")))
    n = F.when(trimmed == "", F.lit(0)).otherwise(F.size("_w")).cast("long")  # an empty text splits into one empty word
    d = d.select("*", n.alias("_n"), F.size(F.array_distinct("_w")).cast("long").alias("_distinct"))
    return d.select(
        *docs.columns,
        (F.col("_n") < 200).alias("fails_A"),
        ((F.col("_n") > 0) & (100 * F.col("_distinct") < 50 * F.col("_n"))).alias("fails_B"),
        (100 * F.col("_capitals").cast("long") > 3 * F.length(text_col).cast("long")).alias("fails_C"),
        F.col(text_col).rlike("[#$%&*|]").alias("fails_D"),
    )


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for every row of docs (doc_id, text, lang); bit k of mask is set where filter LETTERS[k] fails.

    A null text is empty, a null lang the empty string. Filter E fails a row whose text a row of a smaller id has; a null id
    is neither smaller nor greater than another, so such rows pass it, and so do all rows of the least id. good: the id has a
    label row of quality 1, toxic: one of toxic 1; several label rows of an id count together, null ids have no labels.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("t"))
    mask = sum((F.when(F.col(f"fails_{x}"), 1 << k).otherwise(0) for k, x in enumerate("ABCD")), F.lit(0))
    rows = written(failing(d, "t").select("doc_id", "part", mask.alias("mask"), F.sha2(F.col("t").cast("binary"), 256).alias("digest")), "masks")
    owners = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    rows = rows.join(owners.select("digest", "owner"), "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))
    rows = rows.select("doc_id", "part", (F.col("mask") + F.when(copy, F.lit(1 << 4)).otherwise(0)).alias("mask"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left")
    return rows.select("part", "mask", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def orders_of(letters: Sequence[str]) -> list[str]:
    """All orders of the filters, as strings."""
    return ["".join(x) for x in itertools.permutations(letters)]


def audit(masks: DataFrame, letters: Sequence[str] = LETTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """part, filter_order, step (from 1) and the longs of METRICS and shapley, zeros included, for the parts that masks has.

    masks: (part, mask, good, toxic), bit k of mask for letters[k]. orders: those to apply, each an arrangement of the
    letters; all of them where not given. kept: rows that pass this step's filter and all before it. removed: rows
    that this step removes, good_lost and toxic_lost those of them so marked. redundant: rows that fail this filter and were
    removed before. unique_fails: rows that fail this filter and no other. shapley: what the step's filter removes, summed
    over the orders. Repeated rows count as often as they come; without rows there are no parts and the result is empty.
    """
    orders = orders_of(letters) if orders is None else list(orders)
    if not all(x.isascii() and x.isalpha() and len(x) == 1 for x in letters) or any(sorted(o) != sorted(set(letters)) for o in orders):
        raise ValueError("filters are named by letters, and an order holds each of them once")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), count(F.col("good")).alias("n_good"), count(F.col("toxic")).alias("n_toxic"))
    # the orders are fixed and few: each cell is unpivoted against them, and each order against its steps
    long = cells.select("*", F.explode(F.split(F.lit(" ".join(orders)), " ")).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).withColumn("step", F.col("at") + 1)
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{''.join(letters)}', letter) - 1)"))
    hit = F.col("mask").bitwiseAND(F.col("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("now", hit != 0).withColumn("earlier", F.coalesce(F.bit_or(hit).over(before), F.lit(0)) != 0)
    removed = F.col("now") & ~F.col("earlier")
    total = lambda c, of="n": F.sum(F.when(c, F.col(of)).otherwise(F.lit(0).cast("long")))
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        total(~F.col("now") & ~F.col("earlier")).alias("kept"),
        total(removed).alias("removed"),
        total(F.col("now") & F.col("earlier")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"),
    )
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    return out.select("part", "filter_order", "step", *METRICS, "shapley")
