"""Image files of any kind that can be read, told apart by their endings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import fits, png, tiff

IMAGES = "path string, kind string, chan string, y int, row array<int>"


def _fits(content: bytes) -> tuple[str, np.ndarray]:
    """The first unit of one plane, as raw sensor values, or where there is none the first of three, as an image."""
    colour = None
    for keys, at, n in fits.units(content):
        axes = int(keys.get("NAXIS", 0))
        if keys.get("XTENSION", "IMAGE") == "IMAGE" and (axes == 2 or axes == 3 and int(keys["NAXIS3"]) == 3 and colour is None):
            planes = fits.samples(content, keys, at, n).reshape(-1, int(keys["NAXIS2"]), int(keys["NAXIS1"]))
            if axes == 2:
                return "raw", planes
            colour = planes
    if colour is None:
        raise ValueError("there is no image in it")
    return "image", colour


READERS: dict[str, Callable[[bytes], tuple[str, np.ndarray]]] = {
    "fits": _fits, "fit": _fits, "tif": lambda c: ("image", tiff.decode(c)), "tiff": lambda c: ("image", tiff.decode(c)), "png": lambda c: ("image", png.decode(c)),
}


def images_of(files: DataFrame) -> DataFrame:
    """IMAGES rows of files (path, content): kind is raw for sensor values and image for others; channel L, or R, G and B.

    The ending says what a file is, in any case; one that has another, or can't be read, is an error that names it. A file is one
    row of its task.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                ending = path.rpartition(".")[2].lower()
                if ending not in READERS:
                    raise ValueError(f"{path}: images with the ending {ending} are not supported")
                try:
                    kind, planes = READERS[ending](content)
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                for chan, plane in zip("L" if len(planes) == 1 else "RGB", planes, strict=False):
                    yield pd.DataFrame({"path": path, "kind": kind, "chan": chan, "y": range(len(plane)), "row": list(plane)})

    return files.select("path", "content").mapInPandas(parse, IMAGES)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return images_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
