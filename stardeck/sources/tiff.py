"""TIFF files, grey or RGB, plain or packed by PackBits, LZW or deflate, as row blocks, and back.

8-bit values count 256 each, 16-bit values are taken as they are, floats are shares of 65535.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Tags, and struct codes of field types (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
TYPES = {1: "B", 3: "H", 4: "I"}


def unpack_bits(data: bytes) -> bytes:
    """Runs: a length of up to 127 is followed by one byte more of as they are, one of -1 to -127 by a byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 empties the table, 257 ends; codes grow one entry before the table needs it."""
    at, width = 0, 9
    table: list[bytes] = []
    out, last = [], b""
    while at + width <= 8 * len(data):
        code = _code(data, at, width)
        at += width
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _code(data: bytes, at: int, width: int) -> int:
    three = int.from_bytes(data[at // 8 : at // 8 + 3].ljust(3, b"\0"), "big")
    return (three >> (24 - at % 8 - width)) & ((1 << width) - 1)


#: How strips are packed (fixed values of the format).
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode(content: bytes) -> np.ndarray:
    """(planes, height, width) of values 0 to 65535."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    at = struct.unpack_from(f"{order}I", content, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(f"{order}H", content, at)[0]):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(f"{order}HHI", content, entry)
        if kind in TYPES:
            size = struct.calcsize(TYPES[kind]) * n
            where = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", content, entry + 8)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{TYPES[kind]}", content, where)
    packed = tags.get(COMPRESSION, (1,))[0]
    if packed not in UNPACK:
        raise ValueError(f"TIFF files of compression {packed} are not supported")
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, kind = tags[BITS][0], {1: "u", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    raw = b"".join(UNPACK[packed](content[a : a + n]) for a, n in zip(tags[OFFSETS], tags[COUNTS], strict=True))
    v = np.frombuffer(raw, np.dtype(f"{order}{kind}{bits // 8}"), width * height * samples).reshape(height, width, samples)
    predictor = tags.get(PREDICTOR, (1,))[0]
    if predictor == 2:  # each value is less the one on its left
        v = np.cumsum(v, axis=1, dtype=v.dtype)
    elif predictor != 1:
        raise ValueError(f"TIFF files of predictor {predictor} are not supported")
    if kind == "f":
        v = np.clip(np.nan_to_num(v.astype(np.float64)) * 65535, 0, 65535)
    elif bits == 8:
        v = v.astype(np.int64) * 256
    return np.moveaxis(v.astype(np.int64), 2, 0)


def encode(planes: np.ndarray, strip: int = 64) -> bytes:
    """A 16-bit file of one plane or three, in strips of rows."""
    n, height, width = planes.shape
    rows = np.moveaxis(planes, 0, 2).astype("<u2")
    strips = [rows[y : y + strip].tobytes() for y in range(0, height, strip)]
    offsets = np.cumsum([8, *map(len, strips)])
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [16] * n), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1 if n == 1 else 2])]
    fields += [(OFFSETS, 4, offsets[:-1].tolist()), (SAMPLES, 3, [n]), (ROWS, 4, [strip]), (COUNTS, 4, list(map(len, strips))), (FORMAT, 3, [1] * n)]
    at = int(offsets[-1])
    extra_at, extra, entries = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values in fields:
        data = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(data) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
            extra += data
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(strips) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, chan, y, row): channel L of grey files, R, G and B of the others."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, c in zip(part["path"], part["content"], strict=True):
                planes = decode(c)
                for chan, plane in zip("L" if len(planes) == 1 else "RGB", planes, strict=False):
                    yield pd.DataFrame({"path": p, "chan": chan, "y": range(len(plane)), "row": list(plane)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, chan string, y int, row array<int>")
