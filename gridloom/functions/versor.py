"""Rotations of the globe as unit quaternions (versors), fitted projections. Column expressions; angles in degrees.

A quaternion is a tuple of four columns (w, x, y, z), a direction one of three. Null parts give null results; a turn
between equal directions is none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.projection import Projection

Quaternion = tuple[Column, Column, Column, Column]


def from_angles(lam: Column, phi: Column, gamma: Column) -> Quaternion:
    """The quaternion of a projection's rotation: the product of half-angle turns about three axes."""
    (cl, sl), (cp, sp), (cg, sg) = ((F.cos(F.radians(a) / 2), F.sin(F.radians(a) / 2)) for a in (lam, phi, gamma))
    return cl * cp * cg + sl * sp * sg, sl * cp * cg - cl * sp * sg, cl * sp * cg + sl * cp * sg, cl * cp * sg - sl * sp * cg


def to_angles(q: Quaternion) -> tuple[Column, Column, Column]:
    """(lambda, phi, gamma) of a unit quaternion."""
    w, x, y, z = q
    sine = F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0))
    return F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), F.degrees(F.asin(sine)), F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def direction(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a place."""
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def turn(v: tuple[Column, Column, Column], u: tuple[Column, Column, Column], share: float = 1.0) -> Quaternion:
    """The turn that takes direction v to u, or a share of the way."""
    cx, cy, cz = v[1] * u[2] - v[2] * u[1], v[2] * u[0] - v[0] * u[2], v[0] * u[1] - v[1] * u[0]
    size = F.sqrt(cx * cx + cy * cy + cz * cz)
    half = share * F.acos(F.least(F.greatest(sum((a * b for a, b in zip(v, u)), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))) / 2
    at = lambda c: F.when(size > 0, c / size * F.sin(half)).otherwise(0.0)
    return F.when(size > 0, F.cos(half)).otherwise(1.0), at(cz), -at(cy), at(cx)


def product(p: Quaternion, q: Quaternion) -> Quaternion:
    """p times q (Hamilton)."""
    a, b, c, d = p
    e, f, g, h = q
    return a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e


def fit_projection(points: DataFrame, kind: str, width: float, height: float, lon0: float = 0.0, lat0: float = 0.0) -> Projection:
    """The projection whose image of points (lon, lat) fills and is centred in a box; scale 1 for a single point.

    One aggregation: the box of the points at scale 1.
    """
    x, y = Projection(kind, 1.0, 0.0, 0.0, lon0, lat0).forward(F.col("lon"), F.col("lat"))
    box = points.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, x1, y0, y1 = (v or 0.0 for v in box)
    room = [s / (b - a) for s, a, b in ((width, x0, x1), (height, y0, y1)) if b > a]
    k = min(room) if room else 1.0
    return Projection(kind, k, (width - k * (x0 + x1)) / 2, (height - k * (y0 + y1)) / 2, lon0, lat0)


# Places of a hemisphere at which two projections are compared, and the tolerance in pixels.
SAMPLES, TOLERANCE = ((0, 0), (20, 35), (-40, 10), (15, -25)), 1e-3


def is_orthographic(forward, scale: float, tx: float, ty: float, lon0: float = 0.0, lat0: float = 0.0) -> bool:
    """Whether ``forward(lon, lat)``, which gives (x, y) or None, behaves like the orthographic projection of these
    settings at all samples."""
    p0 = math.radians(lat0)
    for lon, lat in SAMPLES:
        l, p = math.radians(lon - lon0), math.radians(lat)  # noqa: E741
        depth = math.sin(p0) * math.sin(p) + math.cos(p0) * math.cos(p) * math.cos(l)
        want = (tx + scale * math.cos(p) * math.sin(l), ty - scale * (math.cos(p0) * math.sin(p) - math.sin(p0) * math.cos(p) * math.cos(l))) if depth >= 0 else None
        got = forward(lon, lat)
        if (got is None) != (want is None) or (got is not None and max(abs(got[0] - want[0]), abs(got[1] - want[1])) > TOLERANCE):
            return False
    return True
