"""Sky coordinates, time and bodies as column expressions. Angles are in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PI2 = 2 * math.pi
#: cos and sin of the obliquity that the series below were made with, and seconds of arc in a radian (fixed values).
COS_EPS, SIN_EPS, ARC = 0.91748, 0.39778, 206264.8062


def lit(x: float) -> Column:
    return F.lit(float(x))


def angle_between(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """The haversine distance of two points."""
    a, b = F.sin((dec2 - dec1) / 2), F.sin((ra2 - ra1) / 2)
    return 2 * F.asin(F.least(lit(1), F.sqrt(a * a + F.cos(dec1) * F.cos(dec2) * b * b)))


def to_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def from_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    ra = F.atan2(y, x)
    return F.when(ra < 0, ra + PI2).otherwise(ra), F.atan2(z, F.sqrt(x * x + y * y))


def turn(a: Column, b: Column, angle: Column) -> tuple[Column, Column]:
    return F.cos(angle) * a - F.sin(angle) * b, F.sin(angle) * a + F.cos(angle) * b


def to_horizon(ra: Column, dec: Column, sidereal: Column, longitude: Column, latitude: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a point over an observer's horizon; x is up."""
    x, y, z = to_vector(ra, dec)
    y, x = turn(y, x, sidereal + longitude)
    z, x = turn(z, x, latitude)
    return x, y, z


def from_horizon(x: Column, y: Column, z: Column, sidereal: Column, longitude: Column, latitude: Column) -> tuple[Column, Column]:
    z, x = turn(z, x, -latitude)
    y, x = turn(y, x, -(sidereal + longitude))
    return from_vector(x, y, z)


def altitude(ra: Column, dec: Column, sidereal: Column, longitude: Column, latitude: Column) -> Column:
    x, y, z = to_horizon(ra, dec, sidereal, longitude, latitude)
    return F.atan2(x, F.sqrt(y * y + z * z))


def julian_day(day: Column) -> Column:
    """The Julian day number of a date."""
    return F.datediff(day, F.lit("2000-01-01").cast("date")).cast("long") + 2451545


def julian_time(ts: Column) -> Column:
    """The Julian date of a time, to the millisecond."""
    seconds = F.second(ts) + F.floor(F.date_format(ts, "SSS").cast("double")) / 1000
    return julian_day(F.to_date(ts)) + (F.hour(ts) - 12) / lit(24) + F.minute(ts) / lit(1440) + seconds / lit(86400)


def centuries(julian: Column) -> Column:
    return (julian - lit(2451545)) / lit(36525)


def fraction(c: Column) -> Column:
    """The part behind the point, with the number's sign."""
    return c % lit(1)


def sidereal_time(julian: Column) -> Column:
    """Greenwich sidereal time (coefficients: fixed values)."""
    d = julian - lit(2451545)
    t = d / lit(36525)
    degrees = lit(280.46061837) + lit(360.98564736629) * d + lit(0.000387933) * t * t - t * t * t / lit(38710000)
    return F.radians(360 * fraction(degrees / 360))


def _from_ecliptic(x: Column, v: Column, w: Column) -> tuple[Column, Column]:
    y, z = lit(COS_EPS) * v - lit(SIN_EPS) * w, lit(SIN_EPS) * v + lit(COS_EPS) * w
    rho = F.sqrt(1 - z * z)
    ra = 2 * F.atan2(y, x + rho)
    return F.when(ra < 0, ra + PI2).otherwise(ra), F.atan2(z, rho)


def sun(t: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the sun, t in centuries (coefficients: fixed values)."""
    m = PI2 * fraction(lit(0.993133) + lit(99.997361) * t)
    dl = 6893 * F.sin(m) + 72 * F.sin(2 * m)
    l = PI2 * fraction(lit(0.7859453) + m / PI2 + (lit(6191.2) * t + dl) / lit(1296e3))  # noqa: E741
    return _from_ecliptic(F.cos(l), F.sin(l), lit(0))


#: The moon's mean arguments (turns at t = 0 and per century), and its series: amplitude in seconds of arc and
#: multiples of (l, ls, d, f); fixed values.
MOON_ARGUMENTS = {"l0": (0.606433, 1336.855225), "l": (0.374897, 1325.552410), "ls": (0.993133, 99.997361), "d": (0.827361, 1236.853086), "f": (0.259086, 1342.227825)}
MOON_LONGITUDE = [
    (22640, 1, 0, 0, 0), (-4586, 1, 0, -2, 0), (2370, 0, 0, 2, 0), (769, 2, 0, 0, 0), (-668, 0, 1, 0, 0), (-412, 0, 0, 0, 2), (-212, 2, 0, -2, 0),
    (-206, 1, 1, -2, 0), (192, 1, 0, 2, 0), (-165, 0, 1, -2, 0), (-125, 0, 0, 1, 0), (-110, 1, 1, 0, 0), (148, 1, -1, 0, 0), (-55, 0, 0, -2, 2),
]
MOON_LATITUDE = [(-526, 0, 0, -2, 1), (44, 1, 0, -2, 1), (-31, -1, 0, -2, 1), (-23, 0, 1, -2, 1), (11, 0, -1, -2, 1), (-25, -2, 0, 0, 1), (21, -1, 0, 0, 1)]


def with_moon(rows: DataFrame, t: str = "t") -> DataFrame:
    """Adds moon_ra and moon_dec for the centuries in column t; made in steps, so that no expression is repeated in others."""
    turns = {f"_{k}": fraction(lit(x) + lit(y) * F.col(t)) * (1 if k == "l0" else PI2) for k, (x, y) in MOON_ARGUMENTS.items()}

    def series(terms: list[tuple]) -> Column:
        angle = lambda ks: sum((lit(k) * F.col(n) for k, n in zip(ks, ("_l", "_ls", "_d", "_f"), strict=True) if k), lit(0))
        return sum((lit(c) * F.sin(angle(ks)) for c, *ks in terms), lit(0))

    d = rows.withColumns(turns).withColumns({"_dl": series(MOON_LONGITUDE), "_n": series(MOON_LATITUDE)})
    d = d.withColumn("_s", F.col("_f") + (F.col("_dl") + 412 * F.sin(2 * F.col("_f")) + 541 * F.sin("_ls")) / ARC)
    d = d.withColumns({"_long": PI2 * fraction(F.col("_l0") + F.col("_dl") / lit(1296e3)), "_lat": (18520 * F.sin("_s") + F.col("_n")) / ARC})
    ra, dec = _from_ecliptic(F.cos("_lat") * F.cos("_long"), F.cos("_lat") * F.sin("_long"), F.sin("_lat"))
    return d.withColumns({"moon_ra": ra, "moon_dec": dec}).drop(*turns, "_dl", "_n", "_s", "_long", "_lat")


#: Polynomials in t of the moon's elongation and both anomalies, and terms of its phase angle (fixed values).
PHASE_ARGUMENTS = {
    "d": (297.8501921, 445267.1114034, -0.0018819, 1 / 545868, -1 / 113065000),
    "m": (357.5291092, 35999.0502909, -0.0001536, 1 / 24490000),
    "mp": (134.9633964, 477198.8675055, 0.0087414, 1 / 69699, -1 / 14712000),
}


def moon_phase(t: Column) -> Column:
    """The lit share of the moon, 0 to 1."""

    def circle(x: Column) -> Column:
        r = fraction(x / 360) * 360
        return F.when(r < 0, r + 360).otherwise(r)

    power = {k: circle(sum((lit(c) * (t**i if i else lit(1)) for i, c in enumerate(cs)), lit(0))) for k, cs in PHASE_ARGUMENTS.items()}
    d, m, mp = (F.radians(power[k]) for k in ("d", "m", "mp"))
    i = 180 - power["d"] - 6.289 * F.sin(mp) + 2.1 * F.sin(m) - 1.274 * F.sin(2 * d - mp) - 0.658 * F.sin(2 * d) - 0.214 * F.sin(2 * mp) - 0.11 * F.sin(d)
    return (1 + F.cos(F.radians(circle(i)))) / 2


def refraction(alt: Column) -> Column:
    """Atmospheric refraction; altitudes below three degrees count as three (coefficients: fixed values)."""
    c = math.pi / 2 - F.greatest(alt, lit(math.radians(3)))
    return lit(math.radians(57.085 / 3600)) * F.tan(c) - lit(math.radians(0.0666 / 3600)) * F.tan(c)


def zone(ra: Column, dec: Column, n: int = 40) -> tuple[Column, Column]:
    """Keys of an n x n grid over the sky. A right ascension of 0 counts as a full turn, so keys go up to n."""
    r = F.pmod(ra, lit(PI2))
    r = F.when(r == 0, lit(PI2)).otherwise(r)
    d = F.greatest(lit(0), F.least(lit(math.pi), dec + math.pi / 2))
    return F.floor(n * r / PI2).cast("int"), F.floor(n * d / math.pi).cast("int")


def stereographic(x: Column, y: Column, z: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """The plane point of a unit vector seen along z; null for what lies behind."""
    d = F.when(z > -0.999999, 1 + z)
    return scale * 2 * y / d, scale * 2 * x / d
