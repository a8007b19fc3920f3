"""Learned decision lists over text statistics, in DataFrame functions only.

Sequential covering after the manner of RIPPER. Rules for the rejected class are grown one condition
(statistic above or below a threshold) at a time on two thirds of the labelled rows, then shortened on
the other third, both by precision (with one row of either label added, which favours wide rules). Spark counts the labels on both sides of every
threshold in one aggregation for each condition; the driver gets those counts, whose number depends on
statistics and thresholds alone. The list comes out as ordered conditions of a Spark CASE expression.

Cases: a null text has no words and no lines; rows with a null id or label teach nothing, a null id
keeps its row; repeated rows count each time; an id whose labels differ counts as label 0, once; without
labels the list is empty and keeps everything. Columns are read and carried by position, so their names may clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks"]


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool
    at: float

    def column(self) -> Column:
        c = F.col(f"r_{self.rate}")
        return c > self.at if self.above else c <= self.at

    def __str__(self) -> str:
        return f"{self.rate} {'>' if self.above else '<='} {self.at:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects the row, and a row that none meets is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column()
            verdict = F.when(holds, False) if verdict is None else verdict.when(holds, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nkeep"


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the five counts of COUNTS, the rates r_* that rules look at and the columns `carry` as _0, _1, ..., for every row."""
    also = [f"_{k}" for k in range(len(carry))]
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *[F.col(c).alias(k) for c, k in zip(carry, also, strict=True)])
    d = d.select("doc_id", "t", F.filter(F.split("t", WHITE), lambda w: w != "").alias("w"), *also)
    spoken = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        *[F.regexp_count("t", F.lit(kind)).cast("long").alias(name) for name, kind in (("n_symbols", "[#*$%&|<>]"), ("capitals", "\\p{Lu}"), ("marks", "[!?]"))],
        spoken.alias("lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
        *also,
    )
    d = d.withColumn("windows", F.expr("transform(slice(h, 1, cast(greatest(n_words - 2, 0) as int)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2]))"))
    # neighbours in sorted order find the windows that come again; most texts have none and skip the sort
    again = (
        "case when size(array_distinct(windows)) < size(windows) "
        "then sort_array(transform(windows, (x, i) -> struct(x as h, i as i))) "
        "else cast(array() as array<struct<h: bigint, i: int>>) end"
    )
    d = d.drop("h").withColumn("again", F.expr(again))
    covered = (
        "size(array_distinct(flatten(zip_with(again, slice(again, 2, greatest(size(again), 1)), (a, b) -> "
        "case when a.h = b.h then array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2) else cast(array() as array<int>) end))))"
    )
    d = d.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "capitals", "marks"],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        *also,
    )
    each = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rates = {
        "words": F.col("n_words").cast("double"),
        "word_length": each("word_chars", "n_words"),
        "symbols": each("n_symbols", "word_chars"),
        "dup_lines": each("n_dup_lines", "n_lines"),
        "repeats": each("n_repeat_words", "n_words"),
        "capitals": each("capitals", "word_chars"),
        "marks": each("marks", "word_chars"),
    }
    return d.select("doc_id", *COUNTS, *[rates[r].alias(f"r_{r}") for r in RATES], *also)


def _thresholds(labelled: DataFrame, n: int) -> dict[str, list[float]]:
    """Middles between neighbouring quantiles, taken in each class and then together."""
    at = [i / n for i in range(n + 1)]
    rows = labelled.groupBy("bad").agg(*[F.percentile_approx(f"r_{r}", at, 10_000).alias(r) for r in RATES]).collect()
    out = {}
    for r in RATES:
        values = sorted({float(x) for row in rows for x in row[r] or []})
        out[r] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return out


def learn(statistics: DataFrame, labels: DataFrame, label_col: str = "quality", quantiles: int = 24, max_rules: int = 8, max_conditions: int = 3, least: float = 0.9, least_rows: int = 3) -> DecisionList:
    """The decision list that separates label 0 from label 1, from all labelled rows.

    least: a rule ends the list if it is right on a smaller share of the pruning rows that it meets.
    least_rows: and if it meets fewer growing rows of label 0 than this.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col(label_col) == 0).cast("int")).alias("bad"))
    rows = statistics.join(known, "doc_id").select("bad", *[f"r_{r}" for r in RATES], (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"))
    rows = written(rows, "labelled")
    cuts = _thresholds(rows, quantiles)

    def place(r: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in cuts[r]]), lambda t: F.col(f"r_{r}") > t)) if cuts[r] else F.lit(0)

    binned = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), place(r).alias("bin")) for r in RATES]))
    learned = DecisionList()
    left = rows
    while len(learned.rules) < max_rules:
        rule: list[Condition] = []
        now = left.where("grow")
        while len(rule) < max_conditions:
            counts = now.select("bad", binned.alias("b")).groupBy("b.rate", "b.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            best = _best(counts, cuts, least_rows)
            if best is None:
                break
            rule.append(best[0])
            now = now.where(best[0].column())
            if best[1] == 0:
                break
        rule = _pruned(rule, left.where("NOT grow"), least)
        if not rule:
            return learned
        learned.rules.append(rule)
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        left = left.where(~holds)
    return learned


def _best(counts: list, cuts: dict[str, list[float]], least_rows: int) -> tuple[Condition, int] | None:
    """The most precise condition and the label-1 rows that it still meets."""
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for row in counts:
        table.setdefault(row["rate"], {})[row["bin"]] = (row["p"], row["n"])
    found = None
    for r, bins in sorted(table.items()):
        p0, n0 = (sum(x[i] for x in bins.values()) for i in (0, 1))
        if not p0:
            return None
        low = [0, 0]
        for k, at in enumerate(cuts[r]):
            low = [low[i] + bins.get(k, (0, 0))[i] for i in (0, 1)]
            for above, p, n in ((True, p0 - low[0], n0 - low[1]), (False, low[0], low[1])):
                worth = (p + 1) / (p + n + 2)
                if p >= least_rows and n < n0 and worth > (p0 + 1) / (p0 + n0 + 2) + 1e-12 and (found is None or worth > found[0] + 1e-12):
                    found = (worth, Condition(r, above, at), n)
    return found and (found[1], found[2])


def _pruned(rule: list[Condition], rows: DataFrame, least: float) -> list[Condition]:
    """The beginning of the rule that is right most often on rows it was not grown on; nothing, if that is seldom."""
    if not rule:
        return []
    sums, holds = [], F.lit(True)
    for k, c in enumerate(rule):
        holds = holds & c.column()
        sums += [F.sum(F.when(holds, F.col("bad"))).alias(f"p{k}"), F.sum(F.when(holds, 1 - F.col("bad"))).alias(f"n{k}")]
    got = rows.agg(*sums).first()
    scored = [((got[f"p{k}"] or 0), (got[f"n{k}"] or 0)) for k in range(len(rule))]
    k = max(range(len(rule)), key=lambda k: ((scored[k][0] + 1) / (sum(scored[k]) + 2), -k))
    p, n = scored[k]
    return rule[: k + 1] if p >= least * (p + n) else []


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, repeat_percent: int = 50, carry: tuple[str, ...] = (), **how) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and the columns `carry` for every row of docs.

    base_failed: fewer than min_words words, or more than repeat_percent of a hundred of them lie in
    three-word windows that the text has twice. kept: not base_failed, and the learned list keeps it.
    """
    s = written(text_statistics(docs, carry=carry), "statistics")
    rules = learn(s, labels, **how)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    verdict = [failed.alias("base_failed"), (~failed & rules.kept()).alias("kept")]
    return s.select("doc_id", *COUNTS, *verdict, *[F.col(f"_{k}").alias(c) for k, c in enumerate(carry)])
