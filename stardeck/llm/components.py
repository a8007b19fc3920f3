"""Connected components over a table of links, by alternating large-star and small-star steps.

Each step takes the least neighbour of every node by an aggregation and joins it to the links: nothing
gathers a node's neighbours. Links are written to the shared folder after each round; the work ends when a
round changes nothing. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. Large: larger neighbours go to the least one; small: smaller ones and the node do."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b), the least node of its component; order and repeats don't matter."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = written(now, "links")
    mark = _mark(now)
    for _ in range(max_rounds):
        now = written(_star(_star(now, True), False), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads.distinct())
