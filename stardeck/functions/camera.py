"""What a camera, a mount and a plot make of their settings, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sky
from .sky import lit

#: Names of frame types as files have them, and the shares of the gain's range under their names (fixed values).
FRAME_TYPES = {"Light": "light", "Flat": "flat", "Dark": "dark", "Bias": "bias"}
PATTERNS = ["BGGR", "GRBG", "RGGB", "GBRG"]
GAINS = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1.0}
CROPS = {"none": (1, 1), "p75": (3, 4), "p50": (1, 2), "p33": (1, 3), "p25": (1, 4)}
#: How a preview is scaled: a share of the frame, and what it is reduced by beforehand (fixed values).
SCALES = {
    "original": (1, 1, 1), "p400": (1, 1, 1), "p300": (1, 1, 1), "p200": (1, 1, 1), "p75": (3, 4, 1), "p50": (1, 2, 2), "p33": (1, 3, 3), "p25": (1, 4, 4),
    "p15": (15, 100, 4), "p10": (10, 100, 4), "p5": (5, 100, 4),
}
#: Cameras: parts of their names in lower case, the sensor, and the white balance of red, green and blue (fixed values).
CAMERAS = [
    (["asi294mc", "sv405cc"], "Sony IMX294", (1.255, 1.0, 1.607)),
    (["atr3cmos26000kpa", "touptek atr2600c"], "Sony IMX571", (1.251, 1.0, 1.548)),
    (["asi6200mc"], "Sony IMX455", (1.225, 1.0, 1.526)),
    (["asi178mc"], "Sony IMX178", (1.332, 1.0, 1.572)),
    (["asi183mc"], "Sony IMX183", (1.293, 1.0, 1.574)),
]


def frame_type(text: Column, default: Column) -> Column:
    """The frame type of a name in a file; the default for another name."""
    out = F.when(F.lit(False), "")
    for name, kind in FRAME_TYPES.items():
        out = out.when(text == name, kind)
    return out.otherwise(default)


def frame_type_name(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, k in FRAME_TYPES.items():
        out = out.when(kind == k, name)
    return out


def cfa_pattern(text: Column) -> Column:
    """One of the four patterns; null for anything else, which is a frame without colours."""
    return F.when(text.isin(PATTERNS), text)


def gain_value(level: Column, current: Column, least: Column, most: Column) -> Column:
    """The gain under a level's name; "same" leaves what is set."""
    out = F.when(level == "same", current.cast("double"))
    for name, share in GAINS.items():
        out = out.when(level == name, share * (most - least) + least)
    return out


def active_size(size: Column, crop: Column, binning: Column) -> Column:
    """How many pixels of a side are read: cropped first, then binned, both cut to whole pixels."""
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for name, (n, d) in CROPS.items():
        out = out.when(crop == name, F.floor(n * size / d))
    return F.floor(out / binning)


def sensor(camera: Column) -> tuple[Column, Column]:
    """The sensor and the white balance (an array of three) of the first camera of which a part is in the name; null for none."""
    low = F.lower(camera)
    name, balance = F.when(F.lit(False), ""), F.when(F.lit(False), F.array(*[lit(1)] * 3))
    for parts, chip, wb in CAMERAS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        name, balance = name.when(hit, chip), balance.when(hit, F.array(*map(lit, wb)))
    return name, balance


def white_balance(chosen: Column, camera: Column) -> Column:
    """Factors of red, green and blue, the least of them 1: chosen ones, else the camera's, else none."""
    wb = F.coalesce(chosen, sensor(camera)[1], F.array(*[lit(1)] * 3))
    least = F.array_min(wb)
    return F.transform(wb, lambda x: x / F.when(least <= 0, 1.0).otherwise(least))


def preview_size(scale: Column, width: Column, height: Column, area_width: Column, area_height: Column) -> tuple[Column, Column]:
    """The size of a preview of a frame in an area."""
    ratio, area = width / height, area_width / area_height
    square = F.greatest(F.least(area_width, area_height), F.lit(42)).cast("long")
    whole = lambda c: F.floor(c).cast("long")
    w = F.when(scale == "fit", F.when(ratio > area, area_width).otherwise(whole(area_height * ratio))).when(scale == "corners", square)
    h = F.when(scale == "fit", F.when(ratio > area, whole(area_width / ratio)).otherwise(area_height)).when(scale == "corners", square)
    for name, (n, d, _) in SCALES.items():
        w, h = w.when(scale == name, F.floor(n * width / d)), h.when(scale == name, F.floor(n * height / d))
    return w.cast("long"), h.cast("long")


def reduction(scale: Column, width: Column, height: Column, area_width: Column, area_height: Column) -> Column:
    """By what a frame is reduced before it is scaled: 1 to 4."""
    fit = F.lit(1)
    for k in (2, 3, 4):
        fit = F.when((F.floor(width / k) > area_width) & (F.floor(height / k) > area_height), k).otherwise(fit)
    out = F.when(scale == "fit", fit).when(scale == "corners", 1)
    for name, (_, _, k) in SCALES.items():
        out = out.when(scale == name, k)
    return out


def on_target(ra_hours: Column, dec_degrees: Column, ra: Column, dec: Column, tolerance: Column) -> Column:
    """Whether a telescope stands within so many degrees of a place (in radians)."""
    return F.degrees(sky.angle_between(F.radians(ra_hours * 15), F.radians(dec_degrees), ra, dec)) <= tolerance


def mount_move(x: Column, y: Column, ra: tuple[Column, Column], dec: tuple[Column, Column]) -> tuple[Column, Column]:
    """For how long to move both axes so that the picture moves by (x, y); ra and dec are what each moves it by in a unit of time. Null where they are parallel."""
    divider = dec[1] * ra[0] - dec[0] * ra[1]
    divider = F.when(divider != 0, divider)
    return (dec[1] * x - dec[0] * y) / divider, (ra[1] * x - ra[0] * y) / -divider


def axis_step(extent: Column, most: Column) -> Column:
    """The distance of a plot's lines: the first of 0.2, 0.25, 0.4, 0.5, 1 times a power of ten of which fewer than `most` fit in; 1 for no extent."""
    # Rust and SQL round halves away from zero alike; powers beyond these are never needed
    first = F.pow(lit(10), F.round(F.log10(extent))) / 10
    steps = F.array(*[first * float(f"{d}e{k}") for k in range(12) for d in (0.2, 0.25, 0.4, 0.5, 1.0)])
    return F.when(extent == 0, 1.0).otherwise(F.get(F.filter(steps, lambda s: extent / s < most), F.lit(0)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def descend(point: Column, step: float, most: int, f: Callable[[Column], Column]) -> Column:
    """Coordinate descent: in each round every coordinate of an array moves by a step up or down if that lessens f; ends when nothing does, or after `most` rounds."""

    def one(s: Column, i: Column) -> Column:
        moved = lambda by: F.transform(s["p"], lambda x, j: F.when(j == i, x + by).otherwise(x))
        valued = lambda p: _bound(p, lambda q: F.struct(q.alias("p"), f(q).alias("v")))
        lower = lambda t, otherwise: F.when(t["v"] < s["v"], t).otherwise(otherwise)
        return _bound(valued(moved(step)), lambda up: lower(up, _bound(valued(moved(-step)), lambda down: lower(down, s))))

    def round_of(s: Column, _: Column) -> Column:
        start = F.struct(s["p"].alias("p"), s["v"].alias("v"))
        done = F.aggregate(F.sequence(F.lit(0), F.size(point) - 1), start, one)
        moved = _bound(done, lambda d: F.struct(d["p"].alias("p"), d["v"].alias("v"), (~F.coalesce(d["v"] < s["v"], F.lit(False))).alias("ended")))
        return F.when(s["ended"], s).otherwise(moved)

    start = _bound(point, lambda p: F.struct(p.alias("p"), f(p).alias("v"), F.lit(False).alias("ended")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, round_of, lambda s: s["p"])
