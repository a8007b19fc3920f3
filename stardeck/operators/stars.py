"""Star detection and measurement.

Everything up to the candidates works on row blocks by themselves. Growing stars is sequential where they are near one another
(a star may block the next), so tiles of a frame grow theirs in rounds, with the pixels around them; measuring cuts out
what lies under the stars that make the profile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import matrix
from .cuts import cut

#: Limits of the search (fixed values).
DIAMETER, MOST_STARS, MOST_EXTREMA, MOST_POINTS, FACTORS = 32, 500, 5000, 1024, {"low": 30.0, "normal": 15.0, "high": 9.0}


def _median(*values: Column) -> Column:
    return F.sort_array(F.array(*values))[len(values) // 2]


def detection_threshold(rows: DataFrame, sensitivity: str = "normal") -> DataFrame:
    """(frame, threshold): from the squared differences of the ends and the middle of 32-pixel stretches, their upper median."""
    start = F.col("y").bitwiseAND(15)
    n = F.floor((F.size("row") - start) / DIAMETER).cast("int")
    at = lambda k: F.element_at("a", k)
    area = rows.where(n > 0).select("frame", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("row", start + i * DIAMETER + 1, DIAMETER))).alias("a"))
    ends = _median(*[at(k) for k in range(1, 6)]) + _median(*[at(-k) for k in range(1, 6)])
    diff = ends - 2 * _median(*[at(k) for k in (16, 17, 18)])
    d = area.select("frame", diff.cast("long").alias("d")).where(F.abs("d") <= 32767).groupBy("frame", (F.col("d") * F.col("d")).alias("d")).agg(F.count("*").alias("freq"))
    order = Window.partitionBy("frame").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("cum", F.sum("freq").over(order)).withColumn("n", F.sum("freq").over(Window.partitionBy("frame")))
    m = d.where(F.col("cum") > F.floor(F.col("n") / 2)).groupBy("frame").agg(F.min("d").alias("m"))
    k = F.floor(FACTORS[sensitivity] * 0.5 * F.sqrt("m")).cast("int")
    return m.select("frame", F.greatest(F.lit(1), F.least(F.lit(65535), k)).alias("threshold"))


def extrema(rows: DataFrame, thresholds: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, y, x, v, over): pixels whose smoothed value stands out, by `over`, of their stretch's baseline and of both sides.

    The value is the median of three; a side is the rounded-up median of four; the baseline is the median of nine of 72
    pixels (of all, in the last shorter stretch). Places nearer to the border than half a star are left out. Each row is looked at by
    itself where it is, nothing is shuffled but the thresholds.
    """
    half = DIAMETER // 2
    first, last = max(half, 5), min(width - half, width - 6)
    r = rows.where(F.col("y").between(half, height - half)).join(thresholds, "frame").select(F.col("frame").cast("long"), F.col("y").cast("int"), F.col("threshold").cast("long"), "row")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, _ = matrix(batch.column("row"))
            base = np.empty_like(a)
            for k in range(0, a.shape[1], 72):
                part = a[:, k : k + 72]
                nine = part[:, 4::8] if part.shape[1] == 72 else part
                base[:, k : k + 72] = np.sort(nine, axis=1)[:, nine.shape[1] // 2][:, None]
            at = lambda d: a[:, first + d : last + 1 + d]  # noqa: B023, E731
            v = np.maximum(np.minimum(at(-1), at(0)), np.minimum(np.maximum(at(-1), at(0)), at(1)))

            def side(ds: tuple[int, ...]) -> np.ndarray:
                four = [at(d) for d in ds]  # noqa: B023
                return (sum(four) - np.maximum.reduce(four) - np.minimum.reduce(four) + 1) // 2

            over = v - base[:, first : last + 1]
            y, x = np.nonzero((over >= batch.column("threshold").to_numpy()[:, None]) & (side((-5, -4, -3, -2)) < v) & (side((2, 3, 4, 5)) < v))
            yield pa.RecordBatch.from_arrays([batch.column("frame").take(pa.array(y)), batch.column("y").take(pa.array(y)), *[pa.array(c, pa.int32()) for c in (x + first, v[y, x], over[y, x])]], ["frame", "y", "x", "v", "over"])

    return r.mapInArrow(find, "frame long, y int, x int, v int, over int")


def few_extrema(points: DataFrame, thresholds: DataFrame, most: int = MOST_EXTREMA) -> tuple[DataFrame, DataFrame]:
    """The extrema that remain, and the thresholds that leave them: raised by half until fewer than `most` remain.

    points: extrema() of thresholds (frame, threshold), whose `over` says by how much each stands out, so that every higher
    threshold is answered by counts and the frames are read once: the points are written for that. A threshold that can't be
    raised any more stays.
    """
    points = cut(points)
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(30)), F.array(F.col("threshold").cast("int")),
        lambda a, _: F.when(F.floor(3 * (F.element_at(a, -1) + 1) / 2) > 65535, a).otherwise(F.array_append(a, F.floor(3 * (F.element_at(a, -1) + 1) / 2).cast("int"))),
    )
    t = thresholds.select("frame", F.array_distinct(levels).alias("levels"))
    passed = F.size(F.filter("levels", lambda x: x <= F.col("over")))
    counts = points.join(t, "frame").groupBy("frame", passed.alias("passed")).agg(F.count("*").alias("n"))
    # how many points remain at each level: those that pass it or more
    of = counts.groupBy("frame").agg(F.collect_list(F.struct("passed", "n")).alias("c"))
    remain = lambda k: F.aggregate(F.filter("c", lambda x: x["passed"] > k), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    enough = F.filter(F.sequence(F.lit(0), F.size("levels") - 1), lambda k: remain(k) < most)
    chosen = F.coalesce(F.get(enough, F.lit(0)), F.size("levels") - 1)
    raised = t.join(of, "frame", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<passed:int,n:bigint>>"))).select("frame", F.get("levels", chosen).alias("threshold"))
    kept = points.join(raised, "frame").where("over >= threshold").drop("threshold")
    return kept, raised


def clusters(points: DataFrame, most: int = MOST_STARS) -> DataFrame:
    """(frame, y, x, v): the brightest of each 8-connected group of extrema, the `most` brightest of a frame.

    A frame's extrema are few; they are joined up in one task a frame. Ties go to the lower row, then column.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        at = {(y, x): v for y, x, v in zip(rows["y"], rows["x"], rows["v"], strict=True)}
        seen, best = set(), []
        for start in sorted(at):
            if start in seen:
                continue
            seen.add(start)
            todo, group = [start], []
            while todo:
                y, x = todo.pop()
                group.append((y, x))
                for near in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if near in at and near not in seen:
                        seen.add(near)
                        todo.append(near)
            best.append(min(group, key=lambda p: (-at[p], p)))
        best = sorted(best, key=lambda p: (-at[p], p))[:most]
        return pd.DataFrame({"frame": rows["frame"].iloc[0], "y": [p[0] for p in best], "x": [p[1] for p in best], "v": [at[p] for p in best]})

    return points.groupBy("frame").applyInPandas(one, "frame long, y int, x int, v int")


STAR = "frame long, star int, x double, y double, background int, max_value int, brightness long, width int, height int, area int, overexposed boolean"
#: Pixels that growing a star can look at on each side of its centre, and how far apart two centres are that can meet.
REACH = DIAMETER + 2
MEET = 2 * REACH
TILE = 512

#: What became of a candidate: number of points it takes, whether it failed, was passed over as taken, and its star if it is one.
FATE = "frame long, k int, y int, x int, v int, threshold int, n int, failed boolean, passed boolean, star array<double>, points array<int>"


def grow(rows: DataFrame, centres: DataFrame, thresholds: DataFrame, ignore_small: bool = False, tile: int = TILE) -> DataFrame:
    """STAR rows: each candidate, brightest first, flooded down to a third of its height over the local background.

    Rejected: what is wider than 32 pixels, has over 1,024 points, touches another star, or has too long an outline.

    A candidate only depends on brighter ones near it. Tiles of the frame that hold candidates, with what lies around them, are cut
    out once. In each round a tile grows those of its candidates for which every brighter one within reach has been settled, in this
    or an earlier round; the brightest that is left can always be grown, so the rounds end, after as many as tiles hang together.
    """
    order = Window.partitionBy("frame").orderBy(F.desc("v"), "y", "x")
    c = centres.select("frame", "y", "x", "v").join(thresholds.select("frame", "threshold"), "frame")
    # at most MOST_STARS rows a frame
    c = c.select(F.col("frame").cast("long").alias("frame"), (F.row_number().over(order) - 1).alias("k"), *[F.col(n).cast("int").alias(n) for n in ("y", "x", "v", "threshold")])
    todo = cut(c.withColumn("n", F.lit(None).cast("int")).withColumn("failed", F.lit(False)).withColumn("passed", F.lit(False)).withColumn("star", F.lit(None).cast("array<double>")).withColumn("points", F.lit(None).cast("array<int>")))
    size = rows.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.count("*").alias("height"), F.max(F.size("row")).alias("width"))
    of = lambda x: F.floor(x / tile).cast("int")
    pieces = _pieces(rows, todo.select("frame", of(F.col("y")).alias("ty"), of(F.col("x")).alias("tx")).distinct(), tile)
    settled = None
    while not todo.isEmpty():
        every = todo if settled is None else todo.unionByName(settled)
        near = lambda x: F.explode(F.sequence(of(F.col(x) - MEET), of(F.col(x) + MEET))).alias(f"t{x}")
        met = every.select("*", near("y")).select("*", near("x"))
        left = todo.select("frame", of(F.col("y")).alias("ty"), of(F.col("x")).alias("tx")).distinct()
        keys = ["frame", "ty", "tx"]
        images, met = pieces.join(left, keys, "left_semi").groupBy(*keys), met.join(left, keys, "left_semi").groupBy(*keys)
        found = cut(images.cogroup(met).applyInPandas(_round(tile, ignore_small), FATE))
        settled = found if settled is None else settled.unionByName(found)
        todo = cut(todo.join(found.select("frame", "k"), ["frame", "k"], "left_anti"))
    if settled is None:
        return rows.sparkSession.createDataFrame([], STAR)
    return settled.join(size, "frame").groupBy("frame").applyInPandas(_ranked, STAR)


def _pieces(rows: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """(frame, ty, tx, y, x0, part), written: of each tile, and REACH pixels around it, the parts of the rows."""
    of = lambda x: F.floor(x / tile).cast("int")
    r = rows.select(F.col("frame").cast("long").alias("frame"), F.col("y").cast("int").alias("y"), "row", F.explode(F.sequence(of(F.col("y") - REACH), of(F.col("y") + REACH))).alias("ty"))
    r = r.join(tiles, ["frame", "ty"]).withColumn("x0", F.greatest(F.col("tx") * tile - REACH, F.lit(0)))
    part = F.slice("row", F.col("x0") + 1, (F.col("tx") + 1) * tile + REACH - F.col("x0"))
    return cut(r.select("frame", "ty", "tx", "y", "x0", part.alias("part")))


def _round(tile: int, ignore_small: bool):
    def one(key: tuple, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in FATE.split(", ")]
        if not len(rows) or not len(near):
            return pd.DataFrame(columns=names)
        _, ty, tx = key
        rows = rows.sort_values("y")
        image, y0, x0 = np.stack(rows["part"].to_numpy()).astype(np.int64), int(rows["y"].iloc[0]), int(rows["x0"].iloc[0])
        near = near.sort_values("k")
        waiting: list[tuple[int, int]] = []
        taken: set[tuple[int, int]] = set()
        for p in near["points"]:
            if p is not None:
                taken |= {(int(y) - y0, int(x) - x0) for y, x in zip(p[::2], p[1::2], strict=True)}
        out = []
        for r in near.itertuples():
            if r.n == r.n and r.n is not None:
                continue
            mine = r.y // tile == ty and r.x // tile == tx
            if not mine or any(abs(r.y - y) <= MEET and abs(r.x - x) <= MEET for y, x in waiting):
                waiting.append((r.y, r.x))
                continue
            fate = grow_one(image, r.y - y0, r.x - x0, r.v, r.threshold, taken, ignore_small, y0, x0)
            taken |= fate.points
            points = [c for y, x in sorted(fate.points) for c in (y + y0, x + x0)]
            out.append((r.frame, r.k, r.y, r.x, r.v, r.threshold, len(fate.points), fate.failed, fate.passed, None if fate.star is None else [float(s) for s in fate.star], points))
        return pd.DataFrame(out, columns=names)

    return one


def _ranked(fates: pd.DataFrame) -> pd.DataFrame:
    """A frame's stars by brightness, from what became of its at most MOST_STARS candidates."""
    names = [c.split()[0] for c in STAR.split(", ")]
    f = fates.sort_values("k")
    stars = _chosen([(n, failed, passed, None if star is None else tuple(star)) for n, failed, passed, star in zip(f["n"], f["failed"], f["passed"], f["star"], strict=True)], int(f["width"].iloc[0]) * int(f["height"].iloc[0]))
    whole = lambda s: (s[0], s[1], *map(int, s[2:8]), bool(s[8]))
    return pd.DataFrame([(int(f["frame"].iloc[0]), k, *whole(s)) for k, s in enumerate(stars)], columns=names)


class Fate:
    """What became of a candidate."""

    def __init__(self, points: set | None = None, failed: bool = False, passed: bool = False, star: tuple | None = None):
        self.points, self.failed, self.passed, self.star = points or set(), failed, passed, star


def grow_one(image: np.ndarray, cy: int, cx: int, top: int, threshold: int, taken: set[tuple[int, int]], ignore_small: bool, y0: int = 0, x0: int = 0) -> Fate:
    """One candidate, where the points `taken` belong to brighter ones. The image's corner is at (y0, x0) of the frame."""
    height, width = image.shape
    if (cy, cx) in taken:
        return Fate(passed=True)
    window = np.sort(image[max(cy - DIAMETER, 0) : cy + DIAMETER + 1, max(cx - DIAMETER, 0) : cx + DIAMETER + 1], axis=None)
    ground = int(window[len(window) // 3])
    if top - ground < max(threshold, 1):
        return Fate()
    floor = ground + (top - ground + 1) // 3
    points, fits = _flood(image, cy, cx, floor, taken)
    if not points or ignore_small and len(points) <= 3:
        return Fate()
    if not fits:
        return Fate(failed=True)
    ys, xs = (np.array(a) for a in zip(*sorted(points), strict=True))
    v = image[ys, xs]
    part = (v - ground) / (top - ground)
    y, x = float((part * (ys + y0)).sum() / part.sum()), float((part * (xs + x0)).sum() / part.sum())
    grown = {(a + d, b + e) for a, b in points for d in (-1, 0, 1) for e in (-1, 0, 1)}
    if int((v - ground).sum()) <= 0 or not _round_enough(grown):
        return Fate(points)
    box = (ys.min(), ys.max(), xs.min(), xs.max())
    over = _plateau(image, grown, round_half(y) - y0, round_half(x) - x0, box, ground)
    inside = sum(0 <= a < height and 0 <= b < width for a, b in grown)
    size = (3 * max(cx - box[2] + 1, box[3] - cx + 1), 3 * max(cy - box[0] + 1, box[1] - cy + 1))
    return Fate(points, star=(x, y, ground, int(top), int((v - ground).sum()), int(size[0]), int(size[1]), inside, over))


def _chosen(fates: list[tuple[int, bool, bool, tuple | None]], pixels: int) -> list[tuple]:
    """The stars of (points, failed, passed, star) in the order of their candidates; none where too much is taken or too many have failed."""
    points = failures = 0
    for n, failed, passed, _ in fates:
        if not passed and (points > pixels // 10 or failures > 1000):
            return []
        points, failures = points + int(n), failures + bool(failed)
    stars = sorted((s for *_, s in fates if s is not None), key=lambda s: -s[4])
    plain = sorted(s[7] for s in stars if not s[8])
    if plain:
        stars = [s for s in stars if s[8] or s[7] < 2 * plain[len(plain) // 2]]
    return stars[:MOST_STARS]


def grow_in(image: np.ndarray, centres: list[tuple], threshold: int, ignore_small: bool) -> list[tuple]:
    """The stars of a whole image, one candidate (y, x, v) after another."""
    taken: set[tuple[int, int]] = set()
    fates = []
    for cy, cx, top in centres:
        f = grow_one(image, cy, cx, top, threshold, taken, ignore_small)
        taken |= f.points
        fates.append((len(f.points), f.failed, f.passed, f.star))
    return _chosen(fates, image.size)


def round_half(x: float) -> int:
    return int(math.floor(x + 0.5))


def _flood(image: np.ndarray, cy: int, cx: int, floor: int, taken: set) -> tuple[set, bool]:
    height, width = image.shape
    points, todo = set(), [(cy, cx)]
    box = [cy, cy, cx, cx]
    while todo:
        y, x = todo.pop()
        if (y, x) in points or not (0 <= y < height and 0 <= x < width) or image[y, x] < floor:
            continue
        box = [min(box[0], y), max(box[1], y), min(box[2], x), max(box[3], x)]
        if (y, x) in taken or len(points) > MOST_POINTS or box[1] - box[0] > DIAMETER or box[3] - box[2] > DIAMETER:
            return points, False
        points.add((y, x))
        todo += [(y + d, x + e) for d in (-1, 0, 1) for e in (-1, 0, 1) if d or e]
    return points, True


def _round_enough(points: set) -> bool:
    edge = sum(not ({(y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)} <= points) for y, x in points)
    return edge < 3 * 2 * math.pi * math.sqrt(len(points) / math.pi)


def _plateau(image: np.ndarray, points: set, y: int, x: int, box: tuple, ground: int) -> bool:
    """Whether more than a quarter of the middle row's values, and of the middle column's, lie in the top tenth."""
    height, width = image.shape
    value = lambda a, b: int(image[a, b]) if 0 <= a < height and 0 <= b < width else 0
    for line in ([(y, b) for b in range(box[2], box[3] + 1)], [(a, x) for a in range(box[0], box[1] + 1)]):
        v = [value(*p) for p in line if p in points]
        if len(v) < 4:
            return False
        bar = max(v) - (max(v) - ground) // 10
        if sum(a > bar for a in v) <= len(v) // 4:
            return False
    return True


def profile_stars(stars: list[tuple], width: int, height: int) -> list[tuple]:
    """Of stars (x, y, background, max_value, width, height) those that make a frame's profile: from the middle outwards until over 50 are found, 101 at most."""
    stars = [s for s in stars if s[3] > s[2]]
    half, centre = min(width, height) / 2, (width // 2, height // 2)
    far = [math.hypot(s[0] - centre[0], s[1] - centre[1]) for s in stars]
    chosen: list[tuple] = []
    for ring in (0.5, 0.66, 0.75, 1.0, math.inf):
        chosen = [s for s, d in zip(stars, far, strict=True) if d < ring * half][:101]
        if len(chosen) > 50:
            break
    return chosen


def profile_size(chosen: list[tuple], k: int = 4) -> tuple[int, int]:
    """Width and height of the profile, in parts of a pixel: the means of the stars', odd."""
    odd = lambda n: n + 1 - n % 2
    w, h = (odd(min(sum(int(s[i]) for s in chosen) // len(chosen), DIAMETER) * k) for i in (4, 5))
    return w, h


def profile(patches: list[tuple[np.ndarray, int, int]], chosen: list[tuple], width: int, height: int, k: int = 4) -> np.ndarray | None:
    """The median image of the chosen stars, k times finer, scaled to 65535. patches: for each star a part of the frame and where its corner is."""
    if not chosen:
        return None
    w, h = profile_size(chosen, k)
    gy, gx = np.mgrid[0:h, 0:w]
    layers = []
    for (patch, y0, x0), (x, y, ground, top, *_) in zip(patches, chosen, strict=True):
        v = bilinear(patch, x + (gx - w // 2) / k, y + (gy - h // 2) / k, y0, x0, width, height)
        layers.append(np.where(v < 0, np.nan, np.trunc(65535.0 * (v - ground) / (top - ground))))
    stack = np.sort(np.stack(layers), axis=0)
    n = (~np.isnan(stack)).sum(axis=0)
    middle = np.take_along_axis(stack, np.minimum(n // 2, len(layers) - 1)[None], axis=0)[0]
    return np.clip(np.nan_to_num(middle), 0, 65535).astype(np.int64)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray, y0: int = 0, x0: int = 0, width: int | None = None, height: int | None = None) -> np.ndarray:
    """Values at places in 1/256 pixels; -1 outside of the frame, of which image is the part at (y0, x0)."""
    height, width = height or image.shape[0], width or image.shape[1]
    fx, fy = (np.trunc(c * 256).astype(np.int64) for c in (x, y))
    ix, iy = fx // 256, fy // 256
    u, w = fx % 256, fy % 256
    out = (ix < -1) | (iy < -1) | (ix > width - 1) | (iy > height - 1)
    at = lambda i, n, o, m: np.clip(np.clip(i, 0, n - 1) - o, 0, m - 1)
    a, b = at(ix, width, x0, image.shape[1]), at(ix + 1, width, x0, image.shape[1])
    c, d = at(iy, height, y0, image.shape[0]), at(iy + 1, height, y0, image.shape[0])
    top = image[c, a] * (256 - u) + image[c, b] * u
    low = image[d, a] * (256 - u) + image[d, b] * u
    return np.where(out, -1, (top * (256 - w) + low * w) >> 16)


def sizes(p: np.ndarray, k: int = 4) -> tuple[float | None, float, float]:
    """Half-flux diameter, full width at half maximum and ovality of a profile, in pixels."""
    y, x = np.mgrid[0 : p.shape[0], 0 : p.shape[1]]
    total = p.sum()
    hfd = None
    if total:
        cx, cy = (x * p).sum() / total, (y * p).sum() / total
        hfd = float(2 * (np.hypot(x - cx, y - cy) * p).sum() / total / k)
    fwhm = 2 * math.sqrt((p >= 32767).sum() / math.pi) / k
    size = max(p.shape)
    j = np.arange(-(size // 2), size // 2)
    widths = []
    for i in range(32):
        a = math.pi * i / 32
        over = bilinear(p, j * math.cos(a) + p.shape[1] // 2, j * math.sin(a) + p.shape[0] // 2) >= 32767
        ends = np.nonzero(over[:-1] & ~over[1:])[0]
        widths.append(int(j[ends[-1]] - j[np.argmax(over)] + 1) if over.any() and len(ends) else 0)
    widest = max(i for i in range(32) if widths[i] == max(widths))
    return hfd, fwhm, (widths[widest] - widths[(widest + 16) % 32]) / k


CHOSEN = "frame long, n int, x double, y double, background int, max_value int, width int, height int, frame_width int, frame_height int, y0 int, y1 int, x0 int, x1 int"


def measure(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """(frame, stars, hfd, fwhm, ovality) of each frame, from the median profile of its stars that are not overexposed.

    At most 101 stars of a frame are chosen, and of each only what lies under the profile is cut out of the rows.
    """
    size = rows.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.count("*").cast("int").alias("frame_height"), F.max(F.size("row")).alias("frame_width"))
    names = [c.split()[0] for c in CHOSEN.split(", ")]

    def choose(s: pd.DataFrame) -> pd.DataFrame:
        width, height = int(s["frame_width"].iloc[0]), int(s["frame_height"].iloc[0])
        plain = s[~s["overexposed"].astype(bool)].sort_values("star")
        chosen = profile_stars([tuple(t) for t in plain[["x", "y", "background", "max_value", "width", "height"]].itertuples(index=False)], width, height)
        w, h = profile_size(chosen) if chosen else (0, 0)
        box = lambda c, d, most: (max(int(c - d / 8) - 2, 0), min(int(c + d / 8) + 3, most - 1))
        out = [(int(s["frame"].iloc[0]), n, *c, width, height, *box(c[1], h, height), *box(c[0], w, width)) for n, c in enumerate(chosen)]
        return pd.DataFrame(out, columns=names)

    chosen = cut(stars.join(size, "frame").groupBy("frame").applyInPandas(choose, CHOSEN))
    lines = chosen.select("frame", "n", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y"))
    parts = rows.select(F.col("frame").cast("long").alias("frame"), F.col("y").cast("int").alias("y"), "row").join(lines, ["frame", "y"])
    parts = parts.select("frame", "n", "y", F.slice("row", F.col("x0") + 1, F.col("x1") - F.col("x0") + 1)).toDF("frame", "of", "y", "part")

    def one(key: tuple, c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = {"frame": int(key[0]), "hfd": None, "fwhm": None, "ovality": None}
        c = c.sort_values("n")
        of = {n: np.stack(g.sort_values("y")["part"].to_numpy()).astype(np.int64) for n, g in p.groupby("of")}
        patches = [(of[n], int(y0), int(x0)) for n, y0, x0 in zip(c["n"], c["y0"], c["x0"], strict=True)]
        image = profile(patches, [tuple(t) for t in c[["x", "y", "background", "max_value", "width", "height"]].itertuples(index=False)], int(c["frame_width"].iloc[0]), int(c["frame_height"].iloc[0]))
        out["hfd"], out["fwhm"], out["ovality"] = sizes(image)
        return pd.DataFrame([out]).astype({k: "float64" for k in ("hfd", "fwhm", "ovality")})

    found = chosen.groupBy("frame").cogroup(parts.groupBy("frame")).applyInPandas(one, "frame long, hfd double, fwhm double, ovality double")
    counts = stars.groupBy("frame").agg(F.count("*").cast("int").alias("n"))
    every = size.select("frame").join(counts, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("stars"))
    return every.join(found, "frame", "left")


def angular_width(fwhm: Column, pixel_size: Column, focal_length: Column) -> Column:
    """The angle of a width in pixels (pixel size in micrometres, focal length in millimetres)."""
    return 2 * F.atan2(0.5 * fwhm * pixel_size / 1e6, focal_length / 1e3)


def synthetic(spark, frames: int, width: int, height: int, background: int = 100) -> DataFrame:
    """Row blocks of frames with Gaussian stars of sigma 1 on a 5 x 5 grid, shifted by the frame's number, over noise from a hash."""
    star = F.expr("sequence(0, 24)")
    grid = spark.range(frames * height).select(F.expr(f"id div {height}").alias("frame"), F.expr(f"cast(id % {height} as int)").alias("y"))

    def value(x: Column) -> Column:
        def one(total: Column, k: Column) -> Column:
            cx = width * (F.floor(k / 5) * 2 + 1) / 10 + F.pmod(k * 7, F.lit(5)) + F.col("frame")
            cy = height * (F.pmod(k, F.lit(5)) * 2 + 1) / 10 + F.pmod(k * 3, F.lit(7)) + F.col("frame")
            d = (x - cx) * (x - cx) + (F.col("y") - cy) * (F.col("y") - cy)
            return total + F.when(d <= 18, (4500 + k * 80) * F.exp(-d / 2)).otherwise(0.0)

        noise = F.pmod(F.xxhash64(F.col("frame"), F.col("y"), x), F.lit(9))
        return (F.aggregate(star, F.lit(0.0), one) + background + noise).cast("int")

    return grid.select("frame", "y", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value).alias("row"))
