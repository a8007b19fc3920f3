"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

`LineRuns` holds, for batches of documents that came before, one row for each line hash (128 bits) and the
document that owns it. A new batch's hashes are merge-anti-joined with the runs; those that are left belong
to this batch and become a run of level 0, bucketed and sorted by hash. When a level holds `fanout` runs,
they are merged, bucket by bucket, into one of the next level. A batch's documents then lose the lines that
another document owns. A batch that comes later, in another call or by another user of the same runs, is
treated likewise. `dedup_lines` deals one table into batches of rising id.

Only the lines to be dropped travel to their documents. They are found by a join of (hash, document) with
the owners; hashes that more than 1/1000 of all such rows have, at most 1000, are joined apart and go to every
task, so that no line makes a large group.

Cases: a null or empty text is one empty line; a row with a null id is a document of its own that comes after
all others, but null ids of equal texts are one document; rows that repeat an id are one document; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEED, pieces, shared_dir, written

WHITE = b" \t\n\x0b\x0c\r"
#: The id that rows without one are sorted by, behind all others: their tie is over 0, that of a row with an id is 0.
LAST = 2**63 - 1


def line_key(line: bytes) -> bytes:
    """What makes lines equal: A-Z lower-cased and white space stripped at both ends."""
    return line.lower().strip(WHITE)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _keys(text: str | None, least: int) -> list[bytes | None]:
    """The key of each line of a text; None where it is too short to count."""
    keys = (line_key(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n"))
    return [k if _long_enough(k, least) else None for k in keys]


def _line_hashes(least: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
        for batch in pieces(batches, 2):
            rows, first, second = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                keys = {x for x in _keys(text, least) if x is not None}
                rows += [k] * len(keys)
                first += [low(x, SEED) for x in keys]
                second += [high(x, SEED) for x in keys]
            h = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)]
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *h], ["id", "tie", "h1", "h2"])

    return make


def _without(least: int, names: list[str]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in pieces(batches, 1):
            out: list[list] = [[], [], []]
            for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = kept = (text or "").split("\n")
                if drops:
                    gone = {x & (2**64 - 1) for x in drops}
                    kept = [x for x, k in zip(lines, _keys(text, least), strict=True) if k is None or digest(k, SEED) not in gone]
                for column, x in zip(out, ("\n".join(kept), len(lines), len(lines) - len(kept)), strict=True):
                    column.append(x)
            made = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], names)

    return make


def _documents(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(id, tie, text, _0, _1, ...): null ids come last, also behind the greatest id, and are told apart by a hash of their text."""
    i = F.col(id_col).cast("long")
    tie = F.when(i.isNull(), F.shiftright(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 1) + F.lit(2**62 + 1)).otherwise(F.lit(0).cast("long"))
    return docs.select(F.coalesce(i, F.lit(LAST)).alias("id"), tie.alias("tie"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])


MANIFEST = "level int, place int, path string, buckets int, fanout int, least int"


class LineRuns:
    """Runs by level, each a table of (h1, h2, owner, owner_tie). To be used in a `with` block, or forgotten at the end.

    With a folder, one that all machines share, the runs lie there, and keep() writes which they are: opened() has them again in
    a later session. Without one they last as long as this object.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3, least_length: int = 10, folder: str | None = None):
        self.spark, self.fanout, self.least, self.folder = spark, fanout, least_length, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []
        self.paths: dict[int, str] = {}
        self.version = 0

    @classmethod
    def opened(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs that the last keep() of this folder has named."""
        kept = spark.read.schema(f"{MANIFEST}, version int").option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest")
        version = kept.agg(F.max("version")).first()[0]
        rows = sorted(kept.where(F.col("version") == version).collect(), key=lambda r: (r["level"], r["place"]))
        runs = cls(spark, rows[0]["buckets"], rows[0]["fanout"], rows[0]["least"], folder)
        runs.version = version
        for r in rows:
            if r["path"] is not None:
                name = runs._named()
                columns = ", ".join(f"{c} BIGINT" for c in ("h1", "h2", "owner", "owner_tie"))
                spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {runs.buckets} BUCKETS LOCATION '{r['path']}'")
                while len(runs.levels) <= r["level"]:
                    runs.levels.append([])
                runs.levels[r["level"]].append(runs._known(spark.table(name), r["path"]))
        return runs

    def keep(self) -> None:
        """Writes a new version of which runs there are. A write that fails leaves the version before it."""
        held = [(level, k, self.paths[id(run)]) for level, runs in enumerate(self.levels) for k, run in enumerate(runs)]
        rows = [(level, k, path, self.buckets, self.fanout, self.least) for level, k, path in [(-1, 0, None), *held]]
        self.version += 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={self.version}")

    def _named(self) -> str:
        self.names.append(f"line_run_{uuid.uuid4().hex[:12]}")
        return self.names[-1]

    def _known(self, run: DataFrame, path: str) -> DataFrame:
        self.paths[id(run)] = path
        return run

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.forget()

    def forget(self) -> None:
        """Takes the runs' names out of the catalogue; their files stay for plans that read them."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def owners(self) -> DataFrame | None:
        """All runs together; no two have a hash in common."""
        runs = self.runs()
        out = runs[0] if runs else None
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Owners (h1, h2, owner, owner_tie) that the batch's hashes would have, less those that a run has already."""
        for run in self.runs():
            batch = batch.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self._push(self._write(batch.repartition(self.buckets, "h1", "h2")), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(self._write(_merged(full)), level + 1)

    def _write(self, rows: DataFrame) -> DataFrame:
        name = self._named()
        path = f"{self.folder.rstrip('/')}/{name}" if self.folder else shared_dir(self.spark, "line-run")
        made = rows.select("h1", "h2", "owner", "owner_tie").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        made.option("path", path).saveAsTable(name)
        return self._known(self.spark.table(name), path)


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Runs of disjoint hashes as one. All have the same buckets, so the union keeps them and the grouping shuffles nothing."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    one = F.min(F.struct("owner", "owner_tie")).alias("o")
    return out.groupBy("h1", "h2").agg(one).select("h1", "h2", F.col("o.owner").alias("owner"), F.col("o.owner_tie").alias("owner_tie"))


def dedup_lines(docs: DataFrame, least_length: int = 10, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), runs: LineRuns | None = None) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped and the columns `carry` for every row of docs.

    Lines whose key has at least least_length code points and is in several documents stay in the one
    of the smallest id only; lines that `runs` hold from before are dropped everywhere. runs: extended by this
    table's lines (least_length is then theirs); without it they are made for this call. batches: equal shares
    of the ids that enter the runs one after the other.
    """
    if runs is None:
        with LineRuns(docs.sparkSession, fanout=fanout, least_length=least_length) as own:
            return dedup_lines(docs, least_length, batches, fanout, id_col, text_col, carry, own)
    spark, least = docs.sparkSession, runs.least
    d = _documents(docs, id_col, text_col, carry)
    cuts = d.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000).alias("at")).first()["at"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    of_batch = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("id") > c)) if cuts else F.lit(0)
    path = shared_dir(spark, "line-hashes")
    schema = "id long, tie long, h1 long, h2 long"
    lines = d.select("id", "tie", "text").mapInArrow(_line_hashes(least), schema)
    lines.withColumn("batch", of_batch.cast("int")).write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema(f"{schema}, batch int").parquet(path)
    first = F.min(F.struct("id", "tie"))
    for k in range(len(cuts) + 1):  # ids rise from batch to batch, so the first that has a line has its smallest id
        mine = hashed.where(F.col("batch") == k).groupBy("h1", "h2").agg(first.alias("o"))
        runs.add(mine.select("h1", "h2", F.col("o.id").alias("owner"), F.col("o.tie").alias("owner_tie")))
    if runs.folder:
        runs.keep()
    drops = written(_drops(hashed, runs.owners()), "drops")
    d = d.join(drops, ["id", "tie"], "left")
    also = [f"_{k}" for k in range(len(carry))]
    schema = "doc_id long, text string, n_lines long, n_dropped long" + "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in also)
    names = ["doc_id", "text", "n_lines", "n_dropped", *also]
    given = F.when(F.col("tie") == 0, F.col("id")).alias("id")
    out = d.select(given, "text", "drops", *also).mapInArrow(_without(least, names), schema)
    return out.select(*names[:4], *[F.col(f"_{k}").alias(c) for k, c in enumerate(carry)])


def _drops(hashed: DataFrame, owners: DataFrame, often: int = 1000) -> DataFrame:
    """(id, tie, drops): the hashes that each document holds and another owns; within a document 64 bits tell lines apart."""
    least = max(1, hashed.count() // often)
    # fewer than `often` hashes can have so many of the rows: a bound that no input exceeds
    hot = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > least).select("h1", "h2")
    hot = written(hot.join(owners, ["h1", "h2"]), "hot-lines")
    seldom = hashed.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(owners, ["h1", "h2"])
    found = seldom.unionByName(hashed.join(F.broadcast(hot), ["h1", "h2"]))
    lost = found.where("owner <> id OR owner_tie <> tie").select("id", "tie", "h1")
    return lost.groupBy("id", "tie").agg(F.collect_set("h1").alias("drops"))
