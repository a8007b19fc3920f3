"""What a sky map shows of an object, and geometry on its plane, as column expressions."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sky
from .numeric import solve2
from .sky import lit

#: Codes of object types in catalogue files, and the bits under which types are shown (fixed values).
TYPES = {
    "g": "galaxy", "cl": "star cluster", "pn": "planetary nebula", "drkn": "dark nebula", "emn": "emission nebula", "neb": "nebula", "rfn": "reflection nebula",
    "hii": "HII region", "snr": "supernova remnant", "gpair": "galaxy pair", "gtrpl": "galaxy triplet", "ggroup": "group of galaxies", "*ass": "association of stars", "cl+n": "cluster with nebula",
}
STARS, DSO, GALAXIES, CLUSTERS, NEBULAS = 1, 2, 4, 8, 16
GROUPS = {
    GALAXIES: ["galaxy", "galaxy pair", "galaxy triplet", "group of galaxies"],
    CLUSTERS: ["star cluster", "association of stars", "cluster with nebula"],
    NEBULAS: ["planetary nebula", "dark nebula", "emission nebula", "nebula", "reflection nebula", "supernova remnant", "HII region", "cluster with nebula"],
}


def object_type(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, name in TYPES.items():
        out = out.when(F.lower(code) == k, name)
    return out


def shown(kind: Column, flags: Column) -> Column:
    """Whether a type is shown: stars under their bit; others under one of their groups' bits, and that of all deep-sky objects."""
    has = lambda bit: flags.bitwiseAND(bit) != 0
    any_group = F.lit(False)
    for bit, kinds in GROUPS.items():
        any_group = any_group | (kind.isin(kinds) & has(bit))
    return F.coalesce(F.when(kind.isin("star", "double star"), has(STARS)).otherwise(any_group & has(DSO)), F.lit(False))


#: Colour indices and their colours, between which colours are interpolated (fixed values).
COLOURS = [(-0.3, (0.4, 0.66, 1.0)), (0.0, (0.9, 0.9, 0.9)), (0.65, (1.0, 1.0, 0.7)), (1.6, (1.0, 0.9, 0.6)), (2.5, (1.0, 0.4, 0.4))]


def star_colour(bv: Column) -> tuple[Column, ...]:
    out = []
    for k in range(3):
        c = F.when(bv <= COLOURS[0][0], COLOURS[0][1][k])
        for (v1, a), (v2, b) in zip(COLOURS, COLOURS[1:], strict=False):
            c = c.when(bv <= v2, (bv - v1) * ((b[k] - a[k]) / (v2 - v1)) + a[k])
        out.append(c.otherwise(COLOURS[-1][1][k]))
    return tuple(out)


def faintest(zoom: Column, least: float, most: float) -> Column:
    """The faintest magnitude shown at a zoom: from 4 to 20 over the zoom's logarithm."""
    return (F.log10(zoom) - math.log10(least)) * (16 / (math.log10(most) - math.log10(least))) + 4


def star_diameter(mag: Column, faint: Column, scale: float, bright: float, slow: float, largest: float) -> Column:
    light = F.pow(lit(2), 0.4 * (faint - mag)) - 1
    d = F.greatest(scale * light, lit(1))
    d = F.when(mag < 1, F.greatest(d, lit(bright))).otherwise(d)
    return F.least(F.when(d > slow, slow + (d - slow) / 2).otherwise(d), lit(largest))


def ellipse(ra: Column, dec: Column, major: Column, minor: Column, angle: Column, n: int = 66) -> Column:
    """The outline of an object as an array of (ra, dec): half axes major / 2 and minor / 2, turned by angle."""
    a, b = major / 2, minor / 2

    def point(i: Column) -> Column:
        az = i * (2 * math.pi / n)
        r = a * b / F.sqrt((a * F.sin(az)) ** 2 + (b * F.cos(az)) ** 2)
        x, y, z = sky.to_vector(az - angle - math.pi / 2, math.pi / 2 - r)
        z, y = sky.turn(z, y, math.pi / 2 - dec)
        y, x = sky.turn(y, x, math.pi / 2 - ra)
        pra, pdec = sky.from_vector(x, y, z)
        return F.struct(pra.alias("ra"), pdec.alias("dec"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def crossing(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Where segments (x1, y1, x2, y2) meet; null where they don't, or are parallel. Ends belong to a segment."""
    dx1, dy1, dx2, dy2 = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    t, u = solve2(dx1, -dx2, b[0] - a[0], dy1, -dy2, b[1] - a[1])
    met = t.between(0, 1) & u.between(0, 1)
    return F.when(met, a[0] + dx1 * t), F.when(met, a[1] + dy1 * t)


def in_view(points: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Whether an item shows on a screen: an array of its corners, structs (x, y, seen), in order.

    One corner must be seen (stand above the horizon and not behind); and one must lie inside of the rectangle, or an edge of the
    closed outline must meet one of its sides.
    """
    inside = F.exists(points, lambda p: (p["x"] > left) & (p["x"] < right) & (p["y"] > top) & (p["y"] < bottom))
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    edges = F.zip_with(points, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    sides = [(left, top, right, top), (left, bottom, right, bottom), (left, top, left, bottom), (right, top, right, bottom)]

    def meets(e: Column) -> Column:
        out = F.lit(False)
        for side in sides:
            out = out | crossing([e[k] for k in ("x1", "y1", "x2", "y2")], [lit(c) for c in side])[0].isNotNull()
        return out

    return F.exists(points, lambda p: p["seen"]) & (inside | ((F.size(points) >= 2) & F.exists(edges, meets)))


def quad_matrix(corners: list[tuple[float, float]], width: int, height: int) -> list[list[float]]:
    """The projective map from a quadrilateral of the plane to the pixels of a picture; its corners in order from the picture's first pixel. Rows give x, y and the divisor."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    # eight equations for the map from the unit square, whose inverse is scaled
    rows, right = [], []
    for (u, v), (x, y) in zip(((0, 0), (1, 0), (1, 1), (0, 1)), ((x0, y0), (x1, y1), (x2, y2), (x3, y3)), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.linalg.inv(np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3))
    return (np.diag([width, height, 1.0]) @ m).tolist()


def focal_length(pixel_size: Column, pixels: Column, field: Column) -> Column:
    """In millimetres, from a field's angular width: pixel size in micrometres."""
    return 0.5 * pixels * pixel_size / 1000 / F.tan(field / 2)


def solver_field(output: Column) -> dict[str, Column]:
    """Centre, size and turn in radians from what a plate solver prints; null for what is missing."""
    number = r"([0-9.+-]+)"
    got = lambda p, k: F.nullif(F.regexp_extract(output, p, k), F.lit("")).try_cast("double")
    unit = lambda p, k: F.regexp_extract(output, p, k)
    scale = lambda u: F.when(u.isin("degrees", "degree", "deg"), math.pi / 180).when(u.isin("arcminutes", "arcminute"), math.pi / 10800)
    centre = rf"Field center: \(RA,Dec\) = \({number}, {number}\)"
    size = r"Field size: ([0-9.]+) x ([0-9.]+) (\w+)"
    turned = rf"Field rotation angle: up is {number} (\w+)"
    return {
        "ra": F.radians(got(centre, 1)), "dec": F.radians(got(centre, 2)), "width": got(size, 1) * scale(unit(size, 3)), "height": got(size, 2) * scale(unit(size, 3)),
        "rotation": got(turned, 1) * scale(unit(turned, 2)),
    }


def smooth_both_ways(values: Column, keep: float) -> Column:
    """Exponential smoothing of an array forward and backward, the truncated mean of both. Linear in the array, hence in Python: an array that grows in an expression is copied at each step."""

    def one(a: list[int]) -> list[int]:
        return [min(math.floor(y), 65535) for y in accumulate(map(float, a), lambda y, x: (1 - keep) * x + keep * y)]

    def both(a: list[int]) -> list[int]:
        first = one([a[0], *a])[1:] if len(a) else []
        last = one([a[-1], *a[::-1]])[:0:-1] if len(a) else []
        return [math.floor((f + b) / 2) for f, b in zip(first, last, strict=True)]

    @F.pandas_udf("array<int>")
    def smooth(rows: pd.Series) -> pd.Series:
        return rows.map(lambda a: None if a is None else both(list(a)))

    return smooth(values)


def next_flat_exposure(exposure: Column, median: Column, bias: Column) -> Column:
    """The next exposure to try for a flat; unchanged where the median lies between 20 and 30 % of the range over the bias."""
    low, high = bias + 13107, F.least(bias + 19660, F.lit(65535))
    return (
        F.when((low < median) & (median < high), exposure)
        .when(median > 52428, exposure / 2.5)
        .when(median - bias < 13107, exposure * 2.5)
        .when(median < low, exposure * 1.4)
        .otherwise(exposure / 1.4)
    )


def mount_pole(p1: list[Column], p2: list[Column], p3: list[Column], latitude: Column) -> tuple[Column, Column]:
    """Errors in altitude and azimuth of a mount's axis, from three horizon vectors (x up) of one turn of it."""
    u, v = [b - a for a, b in zip(p1, p2, strict=True)], [b - a for a, b in zip(p1, p3, strict=True)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(sum((c * c for c in n), lit(0)))
    up = F.when((n[0] >= 0) == (F.sin(latitude) >= 0), 1.0).otherwise(-1.0) / F.when(size != 0, size)
    x, y, z = (c * up for c in n)
    return F.atan2(x, F.sqrt(y * y + z * z)) - latitude, F.atan2(y, z)
