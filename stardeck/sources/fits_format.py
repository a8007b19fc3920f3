"""FITS as a Spark format: `spark.read.format("fits")` and `df.write.format("fits")`, once register() was called.

A file is read in shares of its rows, each by a task that seeks from header to header and reads nothing but its rows, so a file
may be larger than memory, and one of many gigabytes is read by many tasks. Paths are those that pyarrow's file systems open;
for a store that only Spark opens there is fits.read_rows(), which takes whole files. The writer keeps its files apart until all
tasks have ended well, and then moves them to their names.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .fits import BLOCK, KINDS, ROWS, header_block, parse_cards, samples

ENDINGS = (".fits", ".fit", ".fts")
#: Bytes of a share, and of the rows that are read at once.
SHARE, READ = 64 << 20, 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _hidden(path: str) -> bool:
    return any(part.startswith(("_", ".")) for part in path.split("/"))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the FITS files in a folder and below, or of one file."""
    store, at = _open(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((i.path, i.size) for i in infos if i.is_file and (found.is_file or i.path.lower().endswith(ENDINGS) and not _hidden(i.path[len(at) :])))


@dataclass
class Share(InputPartition):
    """One of `of` equal shares of the rows of a file."""

    path: str
    share: int
    of: int


def image_units(file: pa.NativeFile) -> Iterator[tuple[int, dict[str, str], int, int, int, int]]:
    """(number, keys, where the data begin, planes, height, width) of each image unit; only headers are read."""
    size, at, number = file.size(), 0, 0
    while at + BLOCK <= size:
        keys: dict[str, str] = {}
        done = False
        while not done and at + BLOCK <= size:
            file.seek(at)
            more, done = parse_cards(file.read(BLOCK))
            keys |= more
            at += BLOCK
        dims = [int(keys.get(f"NAXIS{k + 1}", 0)) for k in range(int(keys.get("NAXIS", 0)))]
        n = int(np.prod(dims, dtype=object)) * abs(int(keys.get("BITPIX", 8))) // 8 if dims else 0
        if keys.get("XTENSION", "IMAGE") == "IMAGE" and (len(dims) == 2 or len(dims) == 3 and dims[2] == 3):
            if int(keys["BITPIX"]) not in KINDS:
                raise ValueError(f"BITPIX {keys['BITPIX']} is not supported")
            yield number, keys, at, 1 if len(dims) == 2 else 3, dims[1], dims[0]
        at += -(-n // BLOCK) * BLOCK
        number += 1


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.share = int(options.get("sharebytes", SHARE))
        first, _, last = options.get("rows", ":").partition(":")
        self.first, self.last = int(first or 0), int(last) if last else None

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in listed(self.path):
            of = max(1, -(-size // self.share))
            out += [Share(path, k, of) for k in range(of)]
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as file:
            for number, keys, at, planes, height, width in image_units(file):
                wanted = range(self.first, height if self.last is None else min(self.last, height))
                a, b = (len(wanted) * k // partition.of for k in (partition.share, partition.share + 1))
                line = width * abs(int(keys["BITPIX"])) // 8
                step = max(1, READ // max(line, 1))
                for plane, chan in enumerate("L" if planes == 1 else "RGB"):
                    for k in range(a, b, step):
                        ys = wanted[k : min(k + step, b)]
                        file.seek(at + (plane * height + ys[0]) * line)
                        data = file.read(len(ys) * line)
                        if len(data) < len(ys) * line:
                            raise ValueError(f"{partition.path} ends within its data")
                        values = samples(data, keys, 0, len(data)).astype(np.int32)
                        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(ys) + 1, dtype=np.int32) * width), pa.array(values))
                        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(ys)), pa.array([number] * len(ys), pa.int32()), pa.array([chan] * len(ys)), pa.array(ys, pa.int32()), rows], ["path", "hdu", "chan", "y", "row"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FitsWriter(DataSourceArrowWriter):
    """Rows (frame, y, row), a frame's in one task and in order, as write_rows() deals them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.bits, self.prefix = int(options.get("bits", 16)), options.get("prefix", "frame_")
        self.cards = json.loads(options.get("cards", "{}"))
        if self.bits not in (8, 16):
            raise ValueError("bits must be 8 or 16")
        self.apart = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _open(self.path)
        store.create_dir(f"{folder}/{self.apart}")
        names: list[str] = []
        frame, data, height, width = None, None, 0, 0

        def close() -> None:
            name = f"{self.prefix}{frame:04d}-{uuid.uuid4().hex}.fits"
            with store.open_output_stream(f"{folder}/{self.apart}/{name}") as out:
                out.write(header_block((height, width), self.cards, self.bits))
                size = data.tell()
                data.seek(0)
                while piece := data.read(READ):
                    out.write(piece)
                out.write(b"\0" * (-size % BLOCK))
            names.append(name)

        for batch in iterator:
            for f, y, row in zip(batch.column("frame").to_pylist(), batch.column("y").to_pylist(), batch.column("row"), strict=True):
                if f != frame:
                    if frame is not None:
                        close()
                    frame, data, height, width = f, tempfile.SpooledTemporaryFile(256 << 20), 0, len(row)
                if y != height or len(row) != width:
                    raise ValueError(f"frame {f}: row {y} of {len(row)} pixels where row {height} of {width} is due")
                v = row.values.to_numpy(zero_copy_only=False)
                data.write((v.astype(np.int64) - 32768).astype(">i2").tobytes() if self.bits == 16 else v.astype(">u1").tobytes())
                height += 1
        if frame is not None:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        if self.overwrite:
            for path, _ in listed(self.path):
                store.delete_file(path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{folder}/{self.apart}/{name}", f"{folder}/{name.rpartition('-')[0]}.fits")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        if store.get_file_info(f"{folder}/{self.apart}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.apart}")


class FitsDataSource(DataSource):
    """Reading: row blocks (path, hdu, chan, y, row) of every image unit. Options: rows, as "first:end"; shareBytes, of a file, to a task.

    Writing: a file for each frame of row blocks (frame, y, row). Options: bits, 8 or 16; prefix of the names; cards, a JSON object
    of header keys.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsDataSource)


def read_rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("fits").options(**options).load(path)


def write_rows(rows: DataFrame, path: str, overwrite: bool = False, **options: str) -> None:
    """A FITS file for each frame of row blocks (frame, y, row); rows from 0 on, of one length. All files, or none."""
    register(rows.sparkSession)
    dealt = rows.selectExpr("cast(frame as long) frame", "cast(y as int) y", "cast(row as array<int>) row").repartition("frame").sortWithinPartitions("frame", "y")
    dealt.write.format("fits").options(**options).mode("overwrite" if overwrite else "append").save(path)
