"""What the operators share: the shared folder, bounded pieces of Arrow batches, words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's seed for xxhash64(); the hashes made in tasks are the same numbers.
SEED = 42
#: Rows and bytes of text that a task works on at once; Spark itself bounds what it sends (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 1000
BATCH_BYTES = 8_000_000
#: Spark then removes a query's shuffle files when it has ended; else they stay until the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WHITE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (not yet made) in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a local master gets a temporary folder; a cluster gets an error, as a folder
    on one machine is of no use to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stardeck-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run herein go when these have ended."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def written(df: DataFrame | list[DataFrame], name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: a cut of the lineage that outlives executors.

    Shares in a list are written one after the other; the shuffle files of one are gone before the next.
    """
    shares = df if isinstance(df, list) else [df]
    spark = shares[0].sparkSession
    path = shared_dir(spark, name)
    for share in shares:
        with cleaned(spark):
            share.write.mode("append").parquet(path)
    return spark.read.schema(shares[0].schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes what written() wrote, when nothing will read it any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], text: int, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and `size` bytes of the column number `text`, but of one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + size, side="right"))
            to = max(at + 1, min(to, at + rows))
            yield batch.slice(at, to - at)
            at = to


def bucket_of_id(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8. bytes.split() parts at exactly 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(items: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in items), np.uint64, len(items))


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


#: The constants of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(a: np.ndarray, by: int) -> np.ndarray:
    return (a << np.uint64(by)) | (a >> np.uint64(64 - by))


def chained(a: np.ndarray, seed: np.ndarray | int = SEED) -> np.ndarray:
    """XXH64 of 64-bit numbers, each with its seed. chained(b, chained(a)) is Spark's xxhash64(a, b)."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.uint64) + P5 + np.uint64(8)
        h = _turned(h ^ (_turned(a * P2, 31) * P1), 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
