"""Small numeric pieces as column expressions: medians, least squares, circular means, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted array, which is the upper of two middles."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1))


def median4_up(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The mean of the two middles, rounded up."""
    s = F.sort_array(F.array(a, b, c, d))
    return F.floor((s[1] + s[2] + 1) / 2).cast("int")


def median4_to_zero(a: Column, b: Column, c: Column, d: Column) -> Column:
    s = F.sort_array(F.array(a, b, c, d))
    m = (s[1] + s[2]) / 2
    return F.when(m < 0, F.ceil(m)).otherwise(F.floor(m)).cast("int")


def interpolate(x: Column, x1: float, x2: float, y1: float, y2: float) -> Column:
    return (x - x1) * ((y2 - y1) / (x2 - x1)) + y1


def solve2(a: Column, b: Column, e: Column, c: Column, d: Column, f: Column) -> tuple[Column, Column]:
    """a x + b y = e and c x + d y = f; null without a single solution."""
    det = a * d - b * c
    det = F.when(det != 0, det)
    return (e * d - b * f) / det, (a * f - e * c) / det


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: list[list[Column]], r: list[Column]) -> tuple[Column, ...]:
    """Cramer's rule; null without a single solution."""
    det = det3(m)
    det = F.when(det != 0, det)
    put = lambda k: [[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return tuple(det3(put(k)) / det for k in range(3))


def inverse3(m: list[list[Column]]) -> list[list[Column]]:
    """The inverse of a 3 x 3 matrix, by cofactors; null without one."""
    det = det3(m)
    det = F.when(det != 0, det)

    def minor(i: int, j: int) -> Column:
        (a, b), (c, d) = [[m[r][k] for k in range(3) if k != j] for r in range(3) if r != i]
        return a * d - b * c

    return [[(1 if (i + j) % 2 == 0 else -1) * minor(j, i) / det for j in range(3)] for i in range(3)]


def lines_meet(a1: Column, b1: Column, a2: Column, b2: Column) -> tuple[Column, Column]:
    """Where y = a1 x + b1 and y = a2 x + b2 meet; null for lines of one slope."""
    x = (b2 - b1) / F.when(a1 != a2, a1 - a2)
    return x, a1 * x + b1


def plane_cut(a: Column, b: Column, c: Column, d: Column, y: Column) -> tuple[Column, Column]:
    """The line z = a' x + b' in which the plane a x + b y + c z + d = 0 meets the one of this y; null where c is 0."""
    c = F.when(c != 0, c)
    return -a / c, (-b * y - d) / c


def square_fit(x: Column, y: Column) -> tuple[Column, ...]:
    """Aggregates: a0, a1, a2 of the parabola of least squares through (x, y); null for fewer than three places."""
    s = [F.sum(x**k) if k else F.count(x).cast("double") for k in range(5)]
    t = [F.sum(y * x**k) if k else F.sum(y) for k in range(3)]
    return solve3([s[0:3], s[1:4], s[2:5]], t)


def line_fit(x: Column, y: Column) -> tuple[Column, Column]:
    """Aggregates: slope and intercept."""
    n, sx, sy, sxy, sxx = F.count(x), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x)
    det = n * sxx - sx * sx
    slope = (n * sxy - sx * sy) / F.when(det != 0, det)
    return slope, (sy - slope * sx) / n


def plane_fit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Aggregates: a, b, d of the plane a x + b y + z + d = 0 with the least squares of distances along z."""
    m = [[F.sum(x * x), F.sum(x * y), F.sum(x)], [F.sum(x * y), F.sum(y * y), F.sum(y)], [F.sum(x), F.sum(y), F.count(x).cast("double")]]
    return solve3(m, [-F.sum(x * z), -F.sum(y * z), -F.sum(z)])


def circular_mean(angle: Column) -> Column:
    """An aggregate: the direction of the sum of unit vectors."""
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def wrap(angle: Column) -> Column:
    """An angle of less than three half turns brought into [-pi, pi]."""
    return F.when(angle < -math.pi, angle + 2 * math.pi).when(angle > math.pi, angle - 2 * math.pi).otherwise(angle)


def in_polygon(points: Column, x: Column, y: Column, eps: float = 1e-9) -> Column:
    """Whether a point lies in a polygon (array of structs x, y); on an edge counts as inside. Even-odd rule."""
    edges = F.zip_with(points, F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = F.slice(edges, 1, F.size(points))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (x - a["x"]) * (b["y"] - a["y"]) - (y - a["y"]) * (b["x"] - a["x"])
        within = lambda v, k: v.between(F.least(a[k], b[k]) - eps, F.greatest(a[k], b[k]) + eps)
        return (F.abs(cross) <= eps) & within(x, "x") & within(y, "y")

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = ((a["y"] <= y) & (y < b["y"])) | ((b["y"] <= y) & (y < a["y"]))
        return spans & (a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) > x)

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.when(F.size(points) < 3, False).otherwise(F.exists(edges, on) | odd)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; what can't be compared, as with a value that is not a number, counts as equal."""
    known = ~F.isnan(a) & ~F.isnan(b)
    return F.when(known & (a < b), -1).when(known & (a > b), 1).otherwise(0)
