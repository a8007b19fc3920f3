"""Calibration of raw frames: darks, flats, defects.

Masters are single frames; they are joined to the row blocks of any number of frames by row, so the shuffle
is of row blocks, never of pixels, and a master small enough goes to every task by Spark's own size check. What looks at
neighbouring rows works on bands of a frame, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BAND, Band, by_bands, clipped, colours, lists, matrix, value_counts
from .frames import MAX16, saturate, to_pixels, to_rows


def _mean(rows: DataFrame) -> DataFrame:
    s, n = F.aggregate("row", F.lit(0).cast("long"), lambda a, v: a + v), F.size("row")
    sums = rows.select("frame", s.alias("s"), n.alias("n")).groupBy("frame").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("frame", F.expr("s div n").alias("mean"))


def subtract_dark(rows: DataFrame, dark: DataFrame) -> DataFrame:
    """v - dark + (mean(frame) - mean(dark)) with integer means, saturated; `shift` is what the frame's offset grows by.

    dark: rows of one frame (dark, or bias).
    """
    level = _mean(dark).select(F.col("mean").alias("dark_mean"))
    means = _mean(rows).crossJoin(F.broadcast(level)).select("frame", (F.col("mean") - F.col("dark_mean")).cast("int").alias("shift"))
    both = rows.join(dark.select("y", F.col("row").alias("d")), "y").join(means, "frame")
    row = F.zip_with("row", "d", lambda v, d: saturate(v - d + F.col("shift")))
    return both.select("frame", "y", row.alias("row"), "shift")


def flat_of(zero: Column | int, flat_zero: Column | int) -> Callable[[Column, Column], Column]:
    """How a flat's pixel divides a frame's: (v - zero) x 65535 / (flat - flat_zero) + zero."""

    def one(v: Column, f: Column) -> Column:
        # products stay below 2^53, so the double quotient cut toward zero is the integer quotient
        ratio = (v - zero).cast("double") * MAX16 / F.when(f != flat_zero, (f - flat_zero).cast("double"))
        return F.coalesce(saturate(ratio.cast("long") + zero), v)

    return one


def apply_flat(rows: DataFrame, flat: DataFrame, zero: Column | int = 0, flat_zero: int = 0) -> DataFrame:
    """(v - zero) x 65535 / (flat - flat_zero) + zero, truncated and saturated; unchanged where the divisor is 0."""
    both = rows.join(flat.select("y", F.col("row").alias("f")), "y")
    return both.select("frame", "y", F.zip_with("row", "f", flat_of(zero, flat_zero)).alias("row"))


def _rank(hist: DataFrame, keys: list[str], rank: Column, name: str) -> DataFrame:
    """The value of 0-based rank `rank` (a function of n), by running sums over a histogram (keys, v, freq)."""
    order = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("cum", F.sum("freq").over(order)).withColumn("n", F.sum("freq").over(Window.partitionBy(*keys)))
    return h.where(F.col("cum") > rank).groupBy(*keys).agg(F.min("v").alias(name))


def _by_channel(values: DataFrame, name: str, otherwise: int) -> DataFrame:
    """(frame, name_L, name_R, name_G, name_B): a row a frame of values (frame, chan, name)."""
    of = [F.coalesce(F.max(F.when(F.col("chan") == c, F.col(name))), F.lit(otherwise)).cast("long").alias(f"{name}_{c}") for c in "LRGB"]
    return values.groupBy("frame").agg(*of)


def _channel_rows(cfa: str | None) -> Callable[[int, np.ndarray, np.ndarray], Iterator[tuple[str, np.ndarray]]]:
    def of_row(y: int, row: np.ndarray, there: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        c = colours(cfa, y, 1, len(row))[0]
        for chan in dict.fromkeys(c[:2].tolist()):
            yield chan, row[there & (c == chan)]

    return of_row


def normalized_rows(rows: DataFrame, cfa: str | None, zero: int = 0) -> DataFrame:
    """Row blocks of v - zero as a share of the 99th rank of its colour, times 65535, truncated and saturated; unchanged where that is 0."""
    top = _by_channel(_rank(value_counts(rows, _channel_rows(cfa)), ["frame", "chan"], F.floor(99 * F.col("n") / 100), "top"), "top", zero)
    both = rows.select(F.col("frame").cast("long"), F.col("y").cast("int"), "row").join(top, "frame")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, there = matrix(batch.column("row"))
            c = colours(cfa, 0, 2, v.shape[1])[batch.column("y").to_numpy() % 2]
            span = np.zeros(v.shape, np.int64)
            for chan in "LRGB":
                span = np.where(c == chan, batch.column(f"top_{chan}").to_numpy()[:, None] - zero, span)
            ratio = np.sign(v - zero) * (np.abs(v - zero) * MAX16 // np.maximum(np.abs(span), 1)) * np.sign(span)
            yield pa.RecordBatch.from_arrays([batch.column("frame"), batch.column("y"), lists(np.where(span == 0, v, clipped(ratio)), there)], ["frame", "y", "row"])

    return both.mapInArrow(shares, ROWS)


def normalize_flat(rows: DataFrame, cfa: str | None, zero: int = 0) -> DataFrame:
    """(frame, y, x, v) of normalized_rows()."""
    return to_pixels(normalized_rows(rows, cfa, zero))


#: Neighbours of the same colour: of green on diagonals, of red and blue on every second row and column.
_NEAR = [(d, e) for d in range(-2, 3) for e in range(-2, 3)]
SAME = {"L": _NEAR, "G": [p for p in _NEAR if sum(p) % 2 == 0], "RB": [p for p in _NEAR if p[0] % 2 == p[1] % 2 == 0]}


def smooth_flat(rows: DataFrame, cfa: str | None, band: int = BAND) -> DataFrame:
    """The mean of each pixel's 5 x 5 neighbours of its colour, rounded, in bands of rows."""

    def smooth(b: Band) -> pa.RecordBatch:
        if cfa is None:
            out = b.mean(SAME["L"])
        else:
            out = np.where(b.colour(cfa) == "G", b.mean(SAME["G"]), b.mean(SAME["RB"]))
        return _band_rows(b, out)

    return by_bands(rows.select("frame", "y", "row"), 2, smooth, ROWS, band)


ROWS = "frame long, y int, row array<int>"


def _band_rows(b: Band, *images: np.ndarray) -> pa.RecordBatch:
    names = ["frame", "y", "row"] if len(images) == 1 else ["frame", "y", "r", "g", "b"]
    return pa.RecordBatch.from_arrays([pa.array([b.frame] * len(b.ys), pa.int64()), pa.array(b.ys, pa.int32()), *[lists(x) for x in images]], names)


def repair(rows: DataFrame, bad: DataFrame, cfa: str | None, rounds: int = 3, band: int = BAND) -> DataFrame:
    """Row blocks with bad pixels (frame, y, x), or (y, x) of every frame, or of another column that rows has, too, as truncated means of their good neighbours of the same colour.

    In at most three rounds: a round's repairs are sources in the next only. Bands take two rows more on each side for every round,
    so frames are shuffled once; a pixel that no round can mend keeps its value.
    """
    keys = [c for c in bad.columns if c in rows.columns and c not in ("x", "row")]
    at = bad.groupBy(*keys).agg(F.collect_set(F.col("x").cast("int")).alias("bad"))
    ring = {k: [p for p in near if p != (0, 0)] for k, near in (("L", [p for p in _NEAR if max(map(abs, p)) < 2]), ("G", [p for p in SAME["G"] if max(map(abs, p)) < 2]), ("RB", SAME["RB"]))}

    def mend(b: Band) -> pa.RecordBatch:
        image, good = b.values.copy(), b.there.copy()
        ys = b.table.column("y").to_numpy().astype(np.int64) - b.y0
        for y, xs in zip(ys.tolist(), b.table.column("bad").to_pylist(), strict=True):
            if xs:
                good[y, b.halo + np.array([x for x in xs if 0 <= x < b.width], np.int64)] = False
        green = colours(cfa, b.y0, len(image), b.width)
        ty, tx = np.nonzero(b.there & ~good)
        for _ in range(rounds):
            # what has a full ring within the band; rows further out are the neighbours' own
            inside = (ty >= 2) & (ty < len(image) - 2)
            py, px = ty[inside], tx[inside]
            if not len(py):
                break
            kind = np.full(len(py), "L") if cfa is None else np.where(green[py, px - b.halo] == "G", "G", "RB")
            value, known = np.zeros(len(py), np.int64), np.zeros(len(py), bool)
            for k in np.unique(kind):
                mine = kind == k
                s, n = np.zeros(mine.sum(), np.int64), np.zeros(mine.sum(), np.int64)
                for dy, dx in ring[k]:
                    g = good[py[mine] + dy, px[mine] + dx]
                    s += np.where(g, image[py[mine] + dy, px[mine] + dx], 0)
                    n += g
                value[mine], known[mine] = s // np.maximum(n, 1), n > 0
            if not known.any():
                break
            image[py[known], px[known]] = value[known]
            good[py[known], px[known]] = True
            left = ~good[ty, tx]
            ty, tx = ty[left], tx[left]
        return _band_rows(b, b.shifted(image, 0, 0))

    return by_bands(rows.join(at, keys, "left").select("frame", "y", "row", "bad"), 2 * rounds, mend, ROWS, band)


def _line_contrasts(rows: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(frame, y, diff) by rows and by columns: 7 times each pixel less the sum of the nearest seven along the line (at the ends the first or last seven)."""
    first = lambda i, n: F.least(F.greatest(i - 3, F.lit(0)), F.lit(n - 7))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    along = rows.select("frame", "y", F.transform("row", lambda v, x: 7 * v.cast("long") - total(F.slice("row", first(x, width) + 1, 7))).alias("diff"))
    order = Window.partitionBy("frame").orderBy("y")
    seven = F.transform("row", lambda v: v.cast("long"))
    for k in range(1, 7):
        seven = F.zip_with(seven, F.lead("row", k).over(order), lambda a, b: a + b)
    down = rows.select("frame", "y", "row", seven.alias("seven"))
    back = F.col("y") - first(F.col("y"), height)
    of = F.when(back == 0, F.col("seven"))
    for k in range(1, 7):
        of = of.when(back == k, F.lag("seven", k).over(order))
    return along, down.select("frame", "y", F.zip_with("row", of, lambda v, s: 7 * v.cast("long") - s).alias("diff"))


def _border(diffs: DataFrame) -> DataFrame:
    """Per frame, the least contrast of a hot pixel, from ranks 60, 70, 80, 90 % drawn on to 100 % and the nine largest."""
    d = diffs.where("diff > 0").groupBy("frame", "diff").agg(F.count("*").alias("freq"))
    order = Window.partitionBy("frame").orderBy("diff").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("cum", F.sum("freq").over(order)).withColumn("n", F.sum("freq").over(Window.partitionBy("frame")))
    at = [F.min(F.when(F.col("cum") > F.floor(k * F.col("n") / 100), F.col("diff"))).cast("double").alias(f"p{k}") for k in (60, 70, 80, 90)]
    in_top = F.greatest(F.least(F.col("freq"), F.col("cum") - (F.col("n") - 9)), F.lit(0))
    s = d.groupBy("frame").agg(*at, F.max("n").alias("n"), F.sum(F.col("diff") * in_top).alias("top"))
    # a parabola through the four ranks by least squares, at 100
    y = [F.col(f"p{k}") for k in (60, 70, 80, 90)]
    end = 0.25 * y[0] - 0.75 * y[1] - 0.75 * y[2] + 2.25 * y[3]
    e = F.when(end < 0, F.ceil(F.round(end, 6))).otherwise(F.floor(F.round(end, 6)))
    most = F.expr("cast(top as bigint) div 9")
    s = s.select("frame", "n", e.alias("e"), most.alias("most"))
    cut = F.when((F.col("n") < 100) | (3 * F.col("e") >= F.col("most")), F.lit(2**31 - 1)).otherwise(F.expr("(3 * cast(e as bigint) + most) div 4"))
    return s.select("frame", cut.alias("border"))


def hot_in_dark(rows: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, y, x) of hot pixels in master darks (row blocks): by rows or by columns. Statistics look at every third line."""
    found = []
    for d, third in zip(_line_contrasts(rows, width, height), ("y", "x"), strict=True):
        seen = d.where("y % 3 = 0") if third == "y" else d.withColumn("diff", F.filter("diff", lambda v, x: x % 3 == 0))
        border = _border(seen.select("frame", F.explode(F.filter("diff", lambda v: v > 0)).alias("diff")))
        hot = F.filter(F.transform("diff", lambda v, x: F.when(v > F.col("border"), x)), lambda x: x.isNotNull())
        found.append(d.join(border, "frame").select("frame", "y", F.explode(hot).alias("x")))
    return found[0].unionByName(found[1]).distinct()


def hot_in_light(frames: DataFrame, cfa: str | None, max_value: int = MAX16, band: int = BAND) -> DataFrame:
    """(frame, y, x) of hot pixels in light frames: local maxima of their colour over a border, in contrast to two rings.

    frames: row blocks, or pixels (frame, y, x, v). A first pass counts how far the maxima of every fourth row of a colour stand out,
    a second one looks at the rings in bands of rows.
    """
    rows = frames if "row" in frames.columns else to_rows(frames)
    step = 1 if cfa is None else 2
    first = {"L": 0} if cfa is None else _first_rows(cfa)
    stride = {c: 4 * (1 if c in "LG" else 2) for c in first}

    def peaks(v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pixels of some rows stand over both neighbours of their colour, and these."""
        v1, v2, ok = np.zeros_like(v), np.zeros_like(v), np.zeros_like(there)
        if v.shape[1] > 2 * step:
            v1[:, step:], v2[:, :-step] = v[:, :-step], v[:, step:]
            ok[:, step:-step] = there[:, step:-step] & there[:, : -2 * step] & there[:, 2 * step :]
        return ok & (v > v1) & (v > v2), v1, v2

    def heights(y: int, row: np.ndarray, there: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        seen = [c for c, y0 in first.items() if y >= y0 and (y - y0) % stride[c] == 0]
        if seen:
            peak, v1, v2 = (a[0] for a in peaks(row[None], there[None]))
            c = colours(cfa, y, 1, len(row))[0]
            for chan in seen:
                mine = peak & (c == chan)
                yield chan, (row - (v1 + v2) // 2)[mine]

    top = _rank(value_counts(rows, heights), ["frame", "chan"], F.floor(99 * F.col("n") / 100), "p99")
    border = F.greatest(F.expr("150 * p99 div 100"), F.lit(max_value // 1000))
    borders = _by_channel(top.select("frame", "chan", F.least(border, F.lit(MAX16 // 2)).alias("border")), "border", 2**31)

    def find(b: Band) -> pa.RecordBatch:
        peak, v1, v2 = peaks(b.shifted(b.values, 0, 0), b.shifted(b.there, 0, 0))
        v, c, least = b.shifted(b.values, 0, 0), b.colour(cfa), np.zeros(peak.shape, np.int64)
        for chan in "LRGB":
            least = np.where(c == chan, b.table.column(f"border_{chan}")[0].as_py(), least)
        y, x = np.nonzero(peak & (v - v1 > least) & (v - v2 > least))
        v, v1, v2, low = v[y, x], v1[y, x], v2[y, x], np.full(len(y), MAX16, np.int64)
        for o in (4, 6):
            s, n = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
            for dy, dx in ((a * o, e * o) for a in (-1, 0, 1) for e in (-1, 0, 1) if a or e):
                at = (b.rows[y] + dy, b.halo + x + dx)
                s += np.where(b.there[at], b.values[at], 0)
                n += b.there[at]
            low = np.where(n > 0, np.minimum(low, s // np.maximum(n, 1)), low)
        hot = (v - v1 > 2 * (v1 - low)) & (v - v2 > 2 * (v2 - low))
        y, x = y[hot], x[hot]
        return pa.RecordBatch.from_arrays([pa.array([b.frame] * len(y), pa.int64()), pa.array(b.ys[y], pa.int32()), pa.array(x, pa.int32())], ["frame", "y", "x"])

    return by_bands(rows.select(F.col("frame").cast("long"), "y", "row").join(borders, "frame"), 6, find, "frame long, y int, x int", band)


def _first_rows(cfa: str) -> dict[str, int]:
    from .frames import CFA

    return {c: 0 if c in CFA[cfa][0] else 1 for c in "RGB"}


def demosaic(rows: DataFrame, width: int, height: int, cfa: str, band: int = BAND) -> DataFrame:
    """(frame, y, r ARRAY, g ARRAY, b ARRAY): bilinear, with rounding; at the border the mean of same-coloured pixels of the 3 x 3."""
    beside, above, corners = [(0, -1), (0, 1)], [(-1, 0), (1, 0)], [(d, e) for d in (-1, 1) for e in (-1, 1)]

    def channels(b: Band) -> pa.RecordBatch:
        v, mine = b.shifted(b.values, 0, 0), b.colour(cfa)
        inside = ((b.ys >= 1) & (b.ys <= height - 2))[:, None] & ((np.arange(b.width) >= 1) & (np.arange(b.width) <= width - 2))[None]
        in_row = colours(cfa, b.y0, len(b.values), b.width + 1)[b.rows][:, 1:]  # the colour of the next pixel
        across, up, diagonal = b.mean(beside), b.mean(above), b.mean(corners)
        green = np.where(mine != "G", b.mean(beside + above), np.where(inside, v, b.mean([(0, 0), *corners])))
        red, blue = (np.where(mine == c, v, np.where(mine != "G", diagonal, np.where(in_row == c, across, up))) for c in "RB")
        return _band_rows(b, red, green, blue)

    return by_bands(rows.select("frame", "y", "row"), 1, channels, "frame long, y int, r array<int>, g array<int>, b array<int>", band)


def compatible(kind: Column, width: Column, height: Column, cfa: Column, wanted: list[str], master_kind: Column, master_width: Column, master_height: Column, master_cfa: Column) -> Column:
    """What is wrong with a master for a frame, the first of: "type", "size", "pattern"; null for one that fits. Frames without a pattern have a null one."""
    return (
        F.when(~F.coalesce(master_kind.isin(wanted), F.lit(False)), "type")
        .when((width != master_width) | (height != master_height), "size")
        .when(~cfa.eqNullSafe(master_cfa), "pattern")
    )


#: Bits of what was done to a frame (fixed values).
BY_DARK, BY_BIAS, BY_DEFECTS, BY_FLAT, BY_SEARCH = 1, 2, 4, 8, 16


def calibrate(rows: DataFrame, cfa: str | None, width: int, height: int, offset: int = 0, dark: DataFrame | None = None, bias: DataFrame | None = None, defects: DataFrame | None = None, flat: DataFrame | None = None, flat_offset: int = 0, search: bool = True) -> tuple[DataFrame, int]:
    """Row blocks of light frames of one camera setting, calibrated, and the bits of what was done.

    dark, or without it bias, is subtracted; the flat divides, after it has been rid of defects and smoothed; defects (y, x) are
    repaired. Without a list of defects the hot pixels of the dark are taken; without either, hot pixels are searched in each
    frame. dark, bias and flat are rows (frame, y, row) of one frame each; the frames' offset grows by what the subtraction shifts.
    """
    done = 0
    if defects is None and dark is not None:
        defects = hot_in_dark(dark, width, height).select("y", "x")
    known = defects is not None
    if flat is not None:
        if known:
            flat = repair(flat, defects.select("y", "x"), cfa)
        flat = smooth_flat(flat, cfa)
    zero: Column | int = offset
    out = rows
    if dark is not None or bias is not None:
        out = subtract_dark(out, dark if dark is not None else bias)
        zero = F.col("shift") + offset
        done |= BY_DARK if dark is not None else BY_BIAS
    if flat is not None:
        out = apply_flat(out, flat, zero, flat_offset)
        done |= BY_FLAT
    out = out.select("frame", "y", "row")
    if known:
        out = repair(out, defects.select("y", "x"), cfa)
        done |= BY_DEFECTS
    elif search:
        out = repair(out, hot_in_light(out, cfa), cfa)
        done |= BY_SEARCH
    return out, done


def build_master(rows: DataFrame, good: DataFrame, kind: str, cfa: str | None, offset: int = 0) -> DataFrame:
    """(y, x, v): the master of the calibration frames among `good` (frame) that passed the temperature's check.

    Flats are normalised first, less `offset`; frames are stacked as the rounded mean of medians of five.
    """
    from .stacking import average_of_medians

    taken = rows.join(good.select("frame").distinct(), "frame", "left_semi")
    return average_of_medians(normalized_rows(taken, cfa, offset) if kind == "flat" else taken)


def noise_gate(frames: DataFrame) -> DataFrame:
    """Quality flags of light frames, each true unless its check is on and fails.

    Columns read: cooler_on, check_temp, temp, target_temp, max_diff; check_fwhm, fwhm, max_fwhm; check_ovality,
    ovality, max_ovality; offset_found. Adds temp_ok, fwhm_ok, ovality_ok, offset_ok, stars_ok, is_ok.
    """
    temp = F.when(F.col("cooler_on") & F.col("check_temp") & F.col("temp").isNotNull(), F.abs(F.col("temp") - F.col("target_temp")) <= F.col("max_diff")).otherwise(True)
    below = lambda on, v, top: F.when(F.col(on) & F.col(v).isNotNull(), F.col(v) < F.col(top)).otherwise(True)
    f = frames.withColumn("temp_ok", temp).withColumn("fwhm_ok", below("check_fwhm", "fwhm", "max_fwhm")).withColumn("ovality_ok", below("check_ovality", "ovality", "max_ovality"))
    f = f.withColumn("offset_ok", F.coalesce("offset_found", F.lit(True))).withColumn("stars_ok", F.col("fwhm_ok") & F.col("ovality_ok"))
    return f.withColumn("is_ok", F.col("stars_ok") & F.col("temp_ok") & F.col("offset_ok"))
