"""A bit-packed star catalogue: four columns, each coded in blocks of 64 differences by exclusive-or.

A block is a 3-bit kind and its bits: all zero, raw, or values cut of their common leading and trailing zeros,
with one or two lengths. Parquet is the primary form; this reads the old one once, and writes it for exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

N = 64
#: Kinds of blocks (the numbers that a file uses are parameters of Layout).
KINDS = ("zeros", "raw", "lz", "lz2", "lztz", "lztz2")


class Layout:
    """The file's marks: length of its signature and the number of each kind of block."""

    def __init__(self, signature: bytes = b"star-catalogue\0", numbers: dict[str, int] | None = None):
        self.signature = signature
        self.number = numbers or {k: i for i, k in enumerate(KINDS)}
        self.kind = {v: k for k, v in self.number.items()}


class Bits:
    """Bits of a byte string, the highest first; or, written to, the bytes of bits. A value is cut out of the few bytes that hold it."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.left = data, 0, 8 * len(data)
        self.parts: list[str] = []

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise EOFError("the file ends within a block")
        end = self.at + n
        last = (end + 7) >> 3
        v = int.from_bytes(self.data[self.at >> 3 : last], "big") >> (8 * last - end) & ((1 << n) - 1)
        self.at = end
        return v

    def put(self, n: int, v: int) -> None:
        self.parts.append(format(v, f"0{n}b"))

    def bytes(self) -> bytes:
        s = "".join(self.parts)
        s += "0" * (-len(s) % 8)
        return int(s or "0", 2).to_bytes(len(s) // 8, "big")


def zigzag(v: int) -> int:
    return (~v << 1 | 1 if v < 0 else v << 1) & 0xFFFFFFFF


def unzigzag(u: int) -> int:
    return ~(u >> 1) if u & 1 else u >> 1


def read_block(bits: Bits, before: int, layout: Layout) -> list[int]:
    kind = layout.kind[bits.take(3)]
    if kind == "zeros":
        return [before] * N
    if kind == "raw":
        lengths, tz = [32] * N, 0
    else:
        large = bits.take(5)
        small = bits.take(5) if kind.endswith("2") else large
        tz = bits.take(5) if "tz" in kind else 0
        size = {f: max(1, 32 - z - tz) for f, z in ((0, small), (1, large))}
        flags = bits.take(N) if kind.endswith("2") else 0
        lengths = [size[flags >> (N - 1 - k) & 1] for k in range(N)]
    out = []
    for n in lengths:
        before ^= bits.take(n) << tz
        out.append(before)
    return out


def write_block(bits: Bits, values: list[int], before: int, layout: Layout, rare: int = 6) -> int:
    """Writes up to 64 values and gives the last. Lengths are two where `rare` longer ones would make all others long."""
    d = []
    for v in values:
        d.append(v ^ before)
        before = v
    d += [0] * (N - len(d))
    zeros = [32 - x.bit_length() for x in d]
    tz = min((x & -x).bit_length() - 1 if x else 32 for x in d)
    if tz == 32:
        bits.put(3, layout.number["zeros"])
        return before
    large = min(zeros)
    small = min(max(sorted(zeros)[rare - 1], large), 31 - tz)
    if small + tz < 2:
        bits.put(3, layout.number["raw"])
        for x in d:
            bits.put(32, x)
        return before
    two = small - large >= 2
    bits.put(3, layout.number["lz" + ("tz" if tz else "") + ("2" if two else "")])
    bits.put(5, large)
    if two:
        bits.put(5, small)
    if tz:
        bits.put(5, tz)
    size = [max(1, 32 - z - tz) for z in (small, large)]
    if two:
        for z in zeros:
            bits.put(1, int(z < small))
    for x, z in zip(d, zeros, strict=True):
        bits.put(size[int(z < small)] if two else size[1], x >> tz)
    return before


def decode(content: bytes, layout: Layout) -> pd.DataFrame:
    """ra and dec in 1e-8 radians, mag and bv."""
    start = len(layout.signature)
    if content[:start] != layout.signature or int.from_bytes(content[start : start + 2], "big") != 1:
        raise ValueError("not a star catalogue of version 1")
    count = int.from_bytes(content[start + 2 : start + 10], "big")
    bits = Bits(content[start + 10 :])
    held: list[list[int]] = [[], [], [], []]
    for _ in range(0, count, N):
        for column in held:
            column += read_block(bits, column[-1] if column else 0, layout)

    ra = np.array(held[0][:count], np.int64)
    dec, mag, bv = ([unzigzag(u) for u in c[:count]] for c in held[1:])
    return pd.DataFrame({"ra_i": ra, "dec_i": np.array(dec, np.int64), "mag": np.array(mag) / 100, "bv": np.array(bv) / 100})


def encode(stars: pd.DataFrame, layout: Layout) -> bytes:
    columns = [
        [int(x) & 0xFFFFFFFF for x in stars["ra_i"]],
        [zigzag(int(x)) for x in stars["dec_i"]],
        [zigzag(round(x * 100)) for x in stars["mag"]],
        [zigzag(round(x * 100)) for x in stars["bv"]],
    ]
    bits, last = Bits(), [0] * 4
    for at in range(0, len(stars), N):
        for k, column in enumerate(columns):
            last[k] = write_block(bits, column[at : at + N], last[k], layout)
    return layout.signature + (1).to_bytes(2, "big") + len(stars).to_bytes(8, "big") + bits.bytes()


def read(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """The stars of all files at path; each file is decoded in one task, as its code is sequential."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield decode(content, layout)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "ra_i long, dec_i long, mag double, bv double")
