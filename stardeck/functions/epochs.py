"""Places of one epoch in another: precession and nutation as one matrix for a pair of times."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sky import from_vector, lit, to_vector

#: Precession angles in seconds of arc, by powers of the interval, with their change over centuries; mean arguments in
#: turns and nutation terms in seconds of arc by multiples of (sun's anomaly, elongation, latitude argument, node); fixed values.
ZETA = ((2306.2181, 1.39656, -0.000139), (0.30188, -0.000345), (0.017998,))
Z_MORE = ((0.79280, 0.000411), (0.000205,))
THETA = ((2004.3109, -0.85330, -0.000217), (-0.42665, -0.000217), (-0.041833,))
ARGUMENTS = ((0.993133, 99.997306), (0.827362, 1236.853087), (0.259089, 1342.227826), (0.347346, -5.372447))
PSI = ((-17.2, (0, 0, 0, 1)), (-1.319, (0, -2, 2, 2)), (-0.227, (0, 0, 2, 2)), (0.206, (0, 0, 0, 2)), (0.143, (1, 0, 0, 0)))
EPS = ((9.203, (0, 0, 0, 1)), (0.574, (0, -2, 2, 2)), (0.098, (0, 0, 2, 2)), (-0.09, (0, 0, 0, 2)))
OBLIQUITY = (0.4090928, -2.2696e-4)


def _about_z(a: float) -> np.ndarray:
    return np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])


def _about_y(a: float) -> np.ndarray:
    return np.array([[math.cos(a), 0, -math.sin(a)], [0, 1, 0], [math.sin(a), 0, math.cos(a)]])


def precession(t1: float, t2: float) -> np.ndarray:
    """From the mean equinox of t1 to that of t2, in centuries."""
    dt = t2 - t1
    total = lambda c, first: sum(np.polyval(p[::-1], t1) * dt ** (k + first) for k, p in enumerate(c))
    zeta = total(ZETA, 1)
    angles = [math.radians(a / 3600) for a in (zeta, zeta + total(Z_MORE, 2), total(THETA, 1))]
    return _about_z(angles[1]) @ _about_y(angles[2]) @ _about_z(angles[0])


def nutation(t: float) -> np.ndarray:
    """From the mean to the true equinox of t; small angles."""
    a = [2 * math.pi * math.fmod(x + y * t, 1) for x, y in ARGUMENTS]
    angle = lambda ks: sum(k * x for k, x in zip(ks, a, strict=True))
    arc = math.pi / 648000
    psi = arc * sum(c * math.sin(angle(ks)) for c, ks in PSI)
    eps = arc * sum(c * math.cos(angle(ks)) for c, ks in EPS)
    e = OBLIQUITY[0] + OBLIQUITY[1] * t
    c, s = psi * math.cos(e), psi * math.sin(e)
    return np.eye(3) + np.array([[0, -c, -s], [c, 0, -eps], [s, eps, 0]])


def convert(ra: Column, dec: Column, t1: float, t2: float) -> tuple[Column, Column]:
    """A place of the equinox of t1 (centuries from 2000) in the true equinox of t2: nine numbers in the plan."""
    m = nutation(t2) @ precession(t1, t2)
    v = to_vector(ra, dec)
    return from_vector(*[sum((lit(m[i, k]) * v[k] for k in range(3)), F.lit(0.0)) for i in range(3)])
