"""FITS files as relations, and back.

Files are read by Spark's binaryFile source, so any store that Spark reads will do; each file is one row and is
parsed in its task. Only its image planes leave the task, as row blocks. Headers are maps; typed columns are
projections of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
#: BITPIX to numpy type (fixed values of the format).
KINDS = {8: ">u1", 16: ">i2", -32: ">f4"}


def parse_cards(block: bytes) -> tuple[dict[str, str], bool]:
    """The keys of one header block, and whether the header ends in it. A value ends at its first slash."""
    keys = {}
    for at in range(0, BLOCK, CARD):
        card = block[at : at + CARD].decode("latin-1")
        name = card[:8].strip().upper()
        if name == "END":
            return keys, True
        if card[8:9] == "=" and name:
            keys[name] = card[9:].split("/")[0].strip().strip("'").strip()
    return keys, False


def units(content: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """(keys, data offset, data length) of each header and data unit; data are padded to whole blocks."""
    at = 0
    while at + BLOCK <= len(content):
        keys: dict[str, str] = {}
        done = False
        while not done and at + BLOCK <= len(content):
            more, done = parse_cards(content[at : at + BLOCK])
            keys |= more
            at += BLOCK
        dims = [int(keys.get(f"NAXIS{k + 1}", 0)) for k in range(int(keys.get("NAXIS", 0)))]
        n = int(np.prod(dims)) * abs(int(keys.get("BITPIX", 8))) // 8 if dims else 0
        yield keys, at, n
        at += -(-n // BLOCK) * BLOCK


def samples(content: bytes, keys: dict[str, str], at: int, n: int) -> np.ndarray:
    """Values 0 to 65535: integers with BZERO added modulo 2^16, floats as shares of 65535, rounded."""
    bits = int(keys["BITPIX"])
    if bits not in KINDS:
        raise ValueError(f"BITPIX {bits} is not supported")
    raw = np.frombuffer(content, KINDS[bits], n // (abs(bits) // 8), at)
    if bits == -32:
        return np.clip(np.nan_to_num(raw.astype(np.float64)) * 65535 + 0.5, 0, 65535).astype(np.int32)
    return (raw.astype(np.int64) + int(float(keys.get("BZERO", "0")))) % 65536


HEADERS = "path string, hdu int, keys map<string,string>"
ROWS = "path string, hdu int, chan string, y int, row array<int>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return headers_of(_files(spark, path))


def headers_of(files: DataFrame) -> DataFrame:
    """The keys of every unit of files (path, content)."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, k, keys) for p, c in zip(part["path"], part["content"], strict=True) for k, (keys, _, _) in enumerate(units(c))]
            yield pd.DataFrame(rows, columns=["path", "hdu", "keys"])

    return files.select("path", "content").mapInPandas(parse, HEADERS)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return rows_of(_files(spark, path))


def rows_of(files: DataFrame) -> DataFrame:
    """Row blocks of every image unit of files (path, content): channel L for two axes, R, G and B for three planes."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, c in zip(part["path"], part["content"], strict=True):
                for k, (keys, at, n) in enumerate(units(c)):
                    axes = int(keys.get("NAXIS", 0))
                    if keys.get("XTENSION", "IMAGE") != "IMAGE" or axes not in (2, 3) or axes == 3 and int(keys["NAXIS3"]) != 3:
                        continue
                    width, height = int(keys["NAXIS1"]), int(keys["NAXIS2"])
                    planes = samples(c, keys, at, n).reshape(-1, height, width)
                    for chan, plane in zip("L" if axes == 2 else "RGB", planes, strict=True):
                        yield pd.DataFrame({"path": p, "hdu": k, "chan": chan, "y": range(height), "row": list(plane)})

    return files.select("path", "content").mapInPandas(parse, ROWS)


def first_image(rows: DataFrame) -> DataFrame:
    """Of each file the first mono unit, or where it has none the first in colour."""
    rank = F.struct(F.when(F.col("chan") == "L", 0).otherwise(1), "hdu")
    best = rows.groupBy("path").agg(F.min(rank).alias("best"))
    return rows.join(best, "path").where(F.col("best") == rank).drop("best")


def key(name: str, kind: str = "string") -> Column:
    return F.try_element_at("keys", F.lit(name.upper())).try_cast(kind)


def frame_info(headers: DataFrame) -> DataFrame:
    """The typed facts of a frame, with defaults for what its header lacks."""
    number = lambda n, d: F.coalesce(key(n, "double"), F.lit(float(d)))
    depth = F.coalesce(key("BITDEPTH", "int"), key("BITPIX", "int"))
    return headers.select(
        "path", "hdu", key("NAXIS1", "int").alias("width"), key("NAXIS2", "int").alias("height"),
        F.try_to_timestamp(key("DATE-OBS"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("time"),
        number("EXPTIME", 0).alias("exposure"), key("TOTALEXP", "double").alias("integr_time"),
        F.when(key("BAYERPAT").isin("RGGB", "BGGR", "GRBG", "GBRG"), key("BAYERPAT")).alias("cfa"),
        number("XBINNING", 1).cast("int").alias("bin"), number("GAIN", 0).cast("int").alias("gain"), number("OFFSET", 0).cast("int").alias("offset"),
        F.coalesce(key("FRAME"), F.lit("Light")).alias("frame_type"), F.coalesce(key("INSTRUME"), F.lit("")).alias("camera"),
        F.when(depth > 0, F.least(F.pow(F.lit(2), depth) - 1, F.lit(65535))).otherwise(65535).cast("int").alias("max_value"),
        key("CCD-TEMP", "double").alias("ccd_temp"), key("FOCALLEN", "double").alias("focal_len"),
        key("PIXSIZE1", "double").alias("pixel_size_x"), key("PIXSIZE2", "double").alias("pixel_size_y"), key("RA", "double").alias("ra"), key("DEC", "double").alias("dec"),
    )


def info_cards(info: DataFrame) -> DataFrame:
    """`cards`, a map from a key to its value as text, for rows of a frame's facts as frame_info() has them; null facts have no card."""
    deep = F.col("max_value") > 255
    text = lambda c: F.col(c).cast("string")
    cards = {
        "SIMPLE": F.lit("T"), "BITPIX": F.when(deep, "16").otherwise("8"), "NAXIS": F.lit("2"), "NAXIS1": text("width"), "NAXIS2": text("height"), "EXTEND": F.lit("T"),
        "BZERO": F.when(deep, "32768"), "EXPTIME": text("exposure"), "TOTALEXP": text("integr_time"), "ROWORDER": F.lit("TOP-DOWN"), "FRAME": F.col("frame_type"),
        "XBINNING": text("bin"), "YBINNING": text("bin"), "GAIN": text("gain"), "OFFSET": text("offset"), "INSTRUME": F.col("camera"), "BAYERPAT": F.col("cfa"), "CCD-TEMP": text("ccd_temp"),
    }
    every = F.create_map(*[x for k, v in cards.items() for x in (F.lit(k), v)])
    return info.withColumn("cards", F.map_filter(every, lambda _, v: v.isNotNull()))


def _card(name: str, value: object) -> bytes:
    text = f"'{value}'" if isinstance(value, str) else ("T" if value else "F") if isinstance(value, bool) else str(value)
    return f"{name:<8}= {text:>20}".ljust(CARD)[:CARD].encode("latin-1")


def _padded(data: bytes, fill: bytes) -> bytes:
    return data.ljust(-(-len(data) // BLOCK) * BLOCK, fill)


def header_block(shape: tuple[int, ...], keys: dict[str, object] | None = None, bits: int = 16) -> bytes:
    """The header of an image of this shape, whose last axis comes first in the file; 16-bit values are stored less 32768."""
    cards = [_card("SIMPLE", True), _card("BITPIX", bits), _card("NAXIS", len(shape))]
    cards += [_card(f"NAXIS{k + 1}", n) for k, n in enumerate(reversed(shape))]
    cards += [_card("BZERO", 32768)] if bits == 16 else []
    cards += [_card(k, v) for k, v in (keys or {}).items() if v is not None] + [b"END".ljust(CARD)]
    return _padded(b"".join(cards), b" ")


def encode(image: np.ndarray, keys: dict[str, object] | None = None, bits: int = 16) -> bytes:
    """A FITS file of one plane (height, width) or three (3, height, width)."""
    data = (image.astype(np.int64) - 32768).astype(">i2").tobytes() if bits == 16 else image.astype(">u1").tobytes()
    return header_block(image.shape, keys, bits) + _padded(data, b"\0")


def encode_table(columns: dict[str, np.ndarray]) -> bytes:
    """A FITS file with an empty first unit and a binary table of doubles."""
    n = len(next(iter(columns.values())))
    first = b"".join([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True), b"END".ljust(CARD)])
    cards = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", 8 * len(columns)), _card("NAXIS2", n), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(columns))]
    for k, name in enumerate(columns):
        cards += [_card(f"TTYPE{k + 1}", name), _card(f"TFORM{k + 1}", "D")]
    data = np.stack(list(columns.values()), 1).astype(">f8").tobytes()
    pad = lambda b, fill: b.ljust(-(-len(b) // BLOCK) * BLOCK, fill)
    return pad(first, b" ") + pad(b"".join([*cards, b"END".ljust(CARD)]), b" ") + pad(data, b"\0")


def to_files(rows: DataFrame, bits: int = 16) -> DataFrame:
    """(frame, content): one FITS file for each frame of row blocks (frame, y, row)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        image = np.stack(part.sort_values("y")["row"].to_numpy())
        return pd.DataFrame({"frame": [int(part["frame"].iloc[0])], "content": [encode(image, bits=bits)]})

    return rows.select("frame", "y", "row").groupBy("frame").applyInPandas(one, "frame long, content binary")


def save(files: DataFrame, folder: str, prefix: str = "frame_") -> None:
    """Writes each file to a folder that all workers see; a task that runs again replaces its files."""
    import os

    os.makedirs(folder, exist_ok=True)

    def write(rows: Iterator) -> None:
        for r in rows:
            own = f"{folder}/.{prefix}{r['frame']:04d}.{os.getpid()}"
            with open(own, "wb") as out:
                out.write(r["content"])
            os.replace(own, f"{folder}/{prefix}{r['frame']:04d}.fits")

    files.foreachPartition(write)
