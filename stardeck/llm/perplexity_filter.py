"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Counts, context sums and continuation counts of the trusted texts' n-grams are made and joined by Spark, order by
order. In logarithms a text's probability is a sum: log P(w | u v) = log g(u v) + log P(w | v), plus a correction
where u v w was seen, and so on down to single words. So the model becomes one table from the 64-bit key of an
n-gram to a number, and a text's score the sum over the keys of all its n-grams.

Scoring is a sharded join of counts. A task counts the keys of a batch of documents, adds up those that are among
the most frequent of the model (`hot`, a table of fixed size that every task has) by itself, and sends the others,
with the documents that hold them and how often, to the shard that their key belongs to. A bit sketch of fixed size
holds back most keys that the model does not know; a key that passes it in error is only sent in vain. A
shard's task looks the keys up in its part of the table and gives the batch's partial sums, packed; a batch's are summed.
There are more shards where much is asked.

Disk holds the table once, as a bucketed table, whose buckets are shards and are not shuffled again, and what is asked
for one share of the documents of several (`ROUNDS`). Each round takes its share to the end before the next begins.

A text is kept if its perplexity is at most a quantile of its language's trusted texts that the model was not trained on.

Cases: a null or empty text is its end alone; a null language is a language of its own; a language without
trusted texts has the threshold of all languages together; without trusted text everything is kept; rows
with a null id are scored and kept or not like others; repeated rows are scored each; labels that repeat an id
are trusted if all are. Only A-Z is lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chained, cleaned, dropped, hashes, pieces, shared_dir, words_of, written
from .lm_scoring import discounts, pack, unpack

START, END = hashes([b"\n start", b"\n end"])
#: The greatest size of the sketch, in bits (16 MB), and bits for each key of a smaller one.
MOST_BITS, BITS_A_KEY = 27, 32
#: Keys that every task scores by itself; model rows in a shard, and bytes asked of one, at most as it is expected.
HOT_KEYS, SHARD_ROWS, DIVISION_BYTES = 1 << 18, 500_000, 32_000_000
#: Shares in which the model is joined and dealt to its shards, and the documents are scored, one share after the other;
#: shards that make a share worth its while.
ROUNDS, SHARDS_A_ROUND = 4, 4
#: Bytes of text for each byte asked, and each order of n-grams, as they are expected.
TEXT_BYTES = 4
#: Counts from here on are one when the most frequent keys are looked for.
MOST_COUNT = 1 << 16


def _rounds(shards: int) -> int:
    return min(ROUNDS, max(1, shards // SHARDS_A_ROUND))


def _stream(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of order - 1 starts, words and end of each text in a row; the text of each; where a token is predicted."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64) + order
    ends = np.cumsum(sizes)
    stream = np.empty(int(sizes.sum()), np.uint64)
    real = np.ones(len(stream), bool)
    for w, end, size in zip(words, ends.tolist(), sizes.tolist(), strict=True):
        first = end - size
        stream[first : first + order - 1] = START
        real[first : first + order - 1] = False
        stream[first + order - 1 : end - 1] = hashes(w)
        stream[end - 1] = END
    return stream, np.repeat(np.arange(len(texts)), sizes), real


def _keys(stream: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order, the key of the n tokens that end at each place (of no meaning where there are fewer)."""
    out = [chained(stream)]
    for _ in range(order - 1):
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(chained(stream, before))
    return out


def _words(order: int, first: int = 1) -> list[str]:
    return [f"w{k}" for k in range(first, order + 1)]


def _count(order: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            stream, _, real = _stream(batch.column(0).to_pylist(), order)
            places = np.nonzero(real)[0]
            _, at, n = np.unique(_keys(stream, order)[-1][places], return_index=True, return_counts=True)
            at = places[at]
            made = [stream[at - k].view(np.int64) for k in range(order - 1, -1, -1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(n)], [*_words(order), "c"])

    return make


def model(trusted: DataFrame, order: int = 3, text_col: str = "text") -> tuple[DataFrame, float] | None:
    """(key, value, n), written, and the logarithm of an unknown word's share; None without text. n: how often, roughly."""
    counted = trusted.select(text_col).mapInArrow(_count(order), ", ".join(f"{c} long" for c in [*_words(order), "c"]))
    made: list[DataFrame] = []

    def put(df: DataFrame | list[DataFrame], name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    def value(df: DataFrame) -> DataFrame:
        return df.select("key", F.log10(F.col("full") / F.col("backed")).alias("value"), F.col("c").alias("n"))

    rows = {order: put(counted.groupBy(*_words(order)).agg(F.sum("c").alias("c")), "ngrams")}
    for n in range(order - 1, 0, -1):  # below the highest order, in how many different places an n-gram ends one of the next
        ends = rows[n + 1].groupBy(*_words(n + 1, 2)).agg(F.count("*").alias("c"))
        rows[n] = put(ends.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in range(1, n + 1)], "c"), "ngrams")
    of = [F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]
    low = rows[1].agg(F.count("*"), *of, F.sum("c")).first()
    if not low[0]:
        return None
    d = discounts(*low[1:5])
    total, more = low[5], low[0] - low[1] - low[2]
    unknown = float((d[1] * low[1] + d[2] * low[2] + d[3] * more) / total / (low[0] + 1))
    p = F.greatest(F.col("c") - _cut(d), F.lit(0.0)) / total + unknown
    full = rows[1].select(F.xxhash64("w1").alias("key"), p.alias("full"), "c")
    values = [full.select("key", F.log10(F.col("full") / unknown).alias("value"), F.col("c").alias("n"))]
    shares: list[DataFrame] = []
    for n in range(2, order + 1):
        *of_counts, size = rows[n].agg(*of, F.count("*")).first()
        d, rounds = discounts(*of_counts), _rounds(size // SHARD_ROWS)
        contexts = put(rows[n].groupBy(*_words(n - 1)).agg((F.sum(_cut(d)) / F.sum("c")).alias("g"), F.sum("c").alias("total")), "contexts")
        values.append(contexts.select(F.xxhash64(*_words(n - 1)).alias("key"), F.log10("g").alias("value"), F.col("total").alias("n")))
        # joins of one share after the other, written, so that shuffle files are never those of all
        begin = F.pmod(F.xxhash64(*_words(n - 1)), F.lit(rounds))
        met = put([rows[n].where(begin == k).join(contexts.where(begin == k), _words(n - 1)) for k in range(rounds)], "met")
        made.remove(rows[n])
        dropped(rows.pop(n))
        met = met.withColumn("key", F.xxhash64(*_words(n))).withColumn("end", F.xxhash64(*_words(n, 2)))
        ends = full.select(F.col("key").alias("end"), F.col("full").alias("lower"))
        backed = F.col("g") * F.col("lower")
        probability = F.greatest(F.col("c") - _cut(d), F.lit(0.0)) / F.col("total") + backed
        dealt = F.pmod("end", F.lit(rounds))
        shares = [met.where(dealt == k).join(ends.where(dealt == k), "end").select("key", probability.alias("full"), "c", backed.alias("backed")) for k in range(rounds)]
        if n < order:  # those of the highest order are read but once
            full = put(shares, "probabilities")
            values.append(value(full))
    # an n-gram has up to two values, one as such and one as a context; both count wherever it stands. Those of the highest order, nearly all, have one
    lower = values[0]
    for v in values[1:]:
        lower = lower.unionByName(v)
    lower = lower.groupBy("key").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    table = written([lower, *map(value, shares)], "model")
    for df in made:
        dropped(df)
    return table, log10(unknown)


def _cut(d: np.ndarray) -> Column:
    return F.when(F.col("c") == 1, float(d[1])).when(F.col("c") == 2, float(d[2])).otherwise(float(d[3]))


def _sketch(keys: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, those at the first `bits` bits of a key set. At most 2^21 numbers reach the driver, whatever the model's size."""
    place = F.shiftrightunsigned("key", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")
    words = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("w").to_numpy().view(np.uint64)
    return out


def _ask(order: int, held: Broadcast, bits: int, shards: int, names: list[str], schema: pa.Schema):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *hot, sketch = held.value
        row = TaskContext.get().partitionId() << 33
        for batch in pieces(batches, 0):
            stream, doc, real = _stream(batch.column(0).to_pylist(), order)
            counted = np.append(real[1:], False) | real  # from the last start on
            k = _keys(stream, order)
            places = [counted] * (order - 1) + [real]
            keys = np.concatenate([x[p] for x, p in zip(k, places, strict=True)])
            docs = np.concatenate([doc[p] for p in places])
            at = np.minimum(np.searchsorted(hot[0], keys), max(len(hot[0]) - 1, 0))
            known = hot[0][at] == keys if len(hot[0]) else np.zeros(len(keys), bool)
            sums = np.bincount(docs[known], hot[1][at[known]], batch.num_rows) if known.any() else np.zeros(batch.num_rows)
            tokens = np.bincount(doc[real], minlength=batch.num_rows)
            at = np.arange(batch.num_rows)
            made = {"batch": pa.array(np.full(batch.num_rows, row)), "at": pa.array(at.astype(np.int32)), "shard": pa.array(((row + at) % shards).astype(np.int32)), "n_tokens": pa.array(tokens), "sum": pa.array(sums)}
            yield _filled(made | dict(zip(names, batch.columns[1:], strict=True)), schema, batch.num_rows)
            keys, docs = keys[~known], docs[~known]
            place = keys >> np.uint64(64 - bits)
            sent = (sketch[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            keys, docs = keys[sent], docs[sent]
            asked = _postings(keys, docs, shards)
            made = {"batch": pa.array([row] * len(asked), pa.int64())} | {c: pa.array([a[i] for a in asked], schema.field(c).type) for i, c in enumerate(("shard", "keys", "many", "docs", "times"))}
            yield _filled(made, schema, len(asked))
            row += batch.num_rows

    return make


def _filled(made: dict[str, pa.Array], schema: pa.Schema, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)


def _postings(keys: np.ndarray, docs: np.ndarray, shards: int) -> list[tuple]:
    """For each shard: the steps between its different keys, in how many documents each is, which, and how often in each; packed."""
    if not len(keys):
        return []
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new_key = np.append(True, keys[1:] != keys[:-1])
    first = np.nonzero(new_key | np.append(True, docs[1:] != docs[:-1]))[0]
    times = np.diff(np.append(first, len(keys)))
    keys, docs, new_key = keys[first], docs[first], new_key[first]
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cut = np.append(np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0], len(keys))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        begin = np.nonzero(new_key[a:b])[0]
        many = np.diff(np.append(begin, b - a))
        of = keys[a:b][begin]
        out.append((int(shard[a]), pack(np.diff(of, prepend=np.uint64(0))), pack(many.astype(np.uint16)), pack(docs[a:b].astype(np.uint16)), pack(times[a:b].astype(np.uint32))))
    return out


def _answer(asked: pa.Table, table: pa.Table) -> pa.Table:
    """For each batch that asks a shard its documents' partial sums, and the documents that went along, with what their task has summed."""
    documents = pc.is_null(asked.column("keys"))
    own = asked.filter(documents).drop_columns(["shard", "keys", "many", "times"]).append_column("sums", pa.nulls(pc.sum(documents).as_py() or 0, pa.binary()))
    asked = asked.filter(pc.invert(documents))
    keys, values = (table.column(c).to_numpy() for c in ("key", "value"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    made: dict[str, list] = {"batch": [], "docs": [], "sums": []}
    for batch, k, many, docs, times in zip(*(asked.column(c).to_pylist() for c in ("batch", "keys", "many", "docs", "times")), strict=True):
        if not len(keys):
            break
        k, docs = np.cumsum(unpack(k, np.uint64), dtype=np.uint64), unpack(docs, np.uint16)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        found = np.where(keys[at] == k, values[at], 0.0)
        part = np.bincount(docs, np.repeat(found, unpack(many, np.uint16)) * unpack(times, np.uint32))
        of = np.nonzero(part)[0]
        for c, x in (("batch", batch), ("docs", pack(of.astype(np.uint16))), ("sums", pack(part[of]))):
            made[c].append(x)
    parts = {c: pa.array(x, own.schema.field(c).type) for c, x in made.items()}
    return pa.concat_tables([own, pa.Table.from_batches([_filled(parts, own.schema, len(parts["batch"]))])])


def _together(batch: pa.Table) -> pa.Table:
    """The documents of a batch, with their partial sums added to what their task has summed."""
    documents = pc.is_null(batch.column("sums"))
    own, parts = batch.filter(documents), batch.filter(pc.invert(documents))
    total = np.zeros(own.num_rows)
    for docs, sums in zip(parts.column("docs").to_pylist(), parts.column("sums").to_pylist(), strict=True):
        total[unpack(docs, np.uint16)] += unpack(sums, np.float64)
    total = own.column("sum").to_numpy() + total[own.column("at").to_numpy()]
    own = own.drop_columns(["batch", "at", "docs", "sums"])
    return own.set_column(own.schema.get_field_index("sum"), "sum", pa.array(total))


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """As many keys of the highest counts as fit into `most`, those of a count together; no rows are sorted in one task."""
    count = F.least(F.col("n"), F.lit(MOST_COUNT)).cast("long")
    least, held = MOST_COUNT, 0
    # at most MOST_COUNT rows
    for r in sorted(table.groupBy(count.alias("n")).agg(F.count("*").alias("keys")).collect(), reverse=True):
        held += r["keys"]
        if held > most:
            break
        least = r["n"]
    return table.where(count >= least).limit(most)


class Shards:
    """A model as it is asked: the most frequent keys with their values, a sketch of all others, and these in a table that has a bucket for each shard."""

    def __init__(self, table: DataFrame, weight: int, hot_keys: int = HOT_KEYS, shard_rows: int = SHARD_ROWS, division: int = DIVISION_BYTES):
        """weight: bytes that are expected to be asked. The table is read here only."""
        spark = table.sparkSession
        known = _most_frequent(table, hot_keys).select("key", "value").toArrow()
        by = np.argsort(known.column("key").to_numpy().view(np.uint64))
        keys, values = (known.column(c).to_numpy()[by] for c in ("key", "value"))
        # a bounded list of keys
        rest = table.join(F.broadcast(spark.createDataFrame(known.select(["key"]))), "key", "left_anti").select("key", "value")
        size = rest.count()
        self.bits = min(MOST_BITS, max(6, (BITS_A_KEY * size).bit_length()))
        self.n = max(4, -(-size // shard_rows), -(-weight // division))
        self.rounds = _rounds(self.n)
        # one broadcast, as a function that holds them is sent, and put on disk, anew with every share
        self.held = spark.sparkContext.broadcast((keys.view(np.uint64), values, _sketch(rest, self.bits)))
        path = shared_dir(spark, "shards")
        self.name = path.rsplit("/", 1)[-1].replace("-", "_")
        rest = rest.withColumn("shard", F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(self.n).cast("long"), 32).cast("int"))
        for k in range(self.rounds):
            share = rest.where(F.pmod("shard", F.lit(self.rounds)) == k).repartition(self.n, "shard")
            with cleaned(spark):
                share.write.mode("append").bucketBy(self.n, "shard").option("path", path).format("parquet").saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def drop(self) -> None:
        dropped(self.rows)
        self.rows.sparkSession.sql(f"DROP TABLE {self.name}")
        self.held.destroy()


def _weight(docs: DataFrame, order: int, text_col: str = "text") -> int:
    """Bytes that the documents are expected to ask."""
    return order * (docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0) // TEXT_BYTES


def perplexity(docs: DataFrame, table: DataFrame, unknown: float, order: int = 3, hot_keys: int = HOT_KEYS, shard_rows: int = SHARD_ROWS, division: int = DIVISION_BYTES, keep: tuple[str, ...] = ("doc_id", "lang"), text_col: str = "text") -> DataFrame:
    """The columns `keep`, n_tokens, log10_prob and perplexity for every row of docs; written."""
    shards = Shards(table, _weight(docs, order, text_col), hot_keys, shard_rows, division)
    return _scored(docs, shards, unknown, order, keep, text_col)


def _scored(docs: DataFrame, shards: Shards, unknown: float, order: int, keep: tuple[str, ...] = ("doc_id", "lang"), text_col: str = "text") -> DataFrame:
    """perplexity(); the shards are dropped when all is scored."""
    d = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])
    names = d.columns[1:]
    schema = ", ".join(["batch long, at int", *[f"{c} {d.schema[c].dataType.simpleString()}" for c in names], "n_tokens long, sum double, shard int, keys binary, many binary, docs binary, times binary"])
    types = [d.limit(0).select(*names).toArrow().schema.field(c) for c in names]
    arrow = pa.schema([("batch", pa.int64()), ("at", pa.int32()), *types, ("n_tokens", pa.int64()), ("sum", pa.float64()), ("shard", pa.int32()), *[(c, pa.binary()) for c in ("keys", "many", "docs", "times")]])
    ask = _ask(order, shards.held, shards.bits, shards.n, names, arrow)
    log_prob = F.col("sum") + F.col("n_tokens") * unknown

    def share(k: int) -> DataFrame:
        # the documents go along with what they ask
        asked = d.where(F.pmod(F.xxhash64(*names), F.lit(shards.rounds)) == k).mapInArrow(ask, schema)
        answer = asked.select("batch", "at", *names, "n_tokens", "sum", "docs", F.col("docs").alias("sums")).schema
        answers = asked.groupBy("shard").cogroup(shards.rows.groupBy("shard")).applyInArrow(_answer, answer)
        # a batch is what a task has worked on at once
        sums = answers.groupBy("batch").applyInArrow(_together, asked.select(*names, "n_tokens", "sum").schema)
        return sums.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "n_tokens", log_prob.alias("log10_prob"), F.pow(F.lit(10.0), -log_prob / F.col("n_tokens")).alias("perplexity"))

    scored = written([share(k) for k in range(shards.rounds)], "scored")
    shards.drop()
    return scored


def training_ids(trusted: DataFrame, docs: DataFrame, sample: int | None = None) -> DataFrame:
    """The half of the trusted ids that the model is made of, by their hash; the other half is held out for the quantiles.

    With a sample, about so many of them a language: those whose hash lies in the share that gives so many.
    So many are expected; how many there are strays from it as a count of independent draws does, by its square root.
    """
    hashed = F.xxhash64("doc_id")
    half = trusted.where(F.pmod(hashed, F.lit(2)) == 0)
    if sample is None:
        return half
    of = written(docs.select("doc_id", "lang").join(half, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang")), "half")
    # written, so that Spark sees how few languages there are
    sizes = written(of.groupBy(F.coalesce("lang", F.lit("\n")).alias("l")).agg(F.count("*").alias("n")), "languages")
    share = F.shiftrightunsigned(hashed, 33) * F.col("n") < 2**31 * sample
    return of.withColumn("l", F.coalesce("lang", F.lit("\n"))).join(sizes, "l").where(share).select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, sample: int | None = None, quantile: float = 0.99, label_col: str = "quality", order: int = 2) -> DataFrame:
    """doc_id, n_tokens, log10_prob, perplexity, threshold and kept for every row of docs.

    Trusted is what has label 1 only. Half of it trains the model, with a sample about so many texts of each language; all other
    trusted texts give the quantiles. order: the length of the longest n-grams.
    """
    trusted = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("q")).where("q = 1").select("doc_id")
    docs = docs.select("doc_id", "lang", "text")
    chosen = written(training_ids(trusted, docs, sample), "trusted")
    made = model(docs.join(chosen, "doc_id", "left_semi"), order)
    if made is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", F.lit(None).cast("long").alias("n_tokens"), nothing.alias("log10_prob"), nothing.alias("perplexity"), nothing.alias("threshold"), F.lit(True).alias("kept"))
    table, unknown = made
    shards = Shards(table, _weight(docs, order))
    dropped(table)
    scored = _scored(docs, shards, unknown, order).withColumn("l", F.coalesce("lang", F.lit("\n")))
    rest = trusted.join(chosen, "doc_id", "left_anti")
    level = F.percentile_approx("perplexity", quantile, 100_000).alias("t")
    held = scored.join(rest, "doc_id", "left_semi")
    # written, so that Spark sees how few languages there are and need not deal the documents by language
    by_language = written(held.groupBy("l").agg(level), "thresholds")
    overall = held.agg(level).first()["t"]
    out = scored.join(by_language, "l", "left")
    threshold = F.coalesce("t", F.lit(overall).cast("double"))
    return out.select("doc_id", "n_tokens", "log10_prob", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))
