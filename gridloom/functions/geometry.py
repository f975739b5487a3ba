"""Planar geometry over coordinate arrays: areas, containment, distances, curves, label boxes. Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(points: Column) -> Column:
    """A ring's points, each followed by the first."""
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def signed_area(points: Column) -> Column:
    """Shoelace area of a ring of [x, y] points."""
    cross = F.zip_with(points, _next(points), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(cross, F.lit(0.0), lambda a, c: a + c) / 2


def point_in_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""

    def crosses(p: Column, q: Column) -> Column:
        spans = (p[1] > y) != (q[1] > y)
        at = p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0])
        return F.when(spans, (x < at).cast("int")).otherwise(0)

    return F.aggregate(F.zip_with(points, _next(points), crosses), F.lit(0), lambda a, c: a + c) % 2 == 1


def distance_to_path(x: Column, y: Column, points: Column) -> Column:
    """Distance of a point to the segments of an open path."""

    def gap(p: Column, q: Column) -> Column:
        dx, dy = q[0] - p[0], q[1] - p[1]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.least(F.greatest(((x - p[0]) * dx + (y - p[1]) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.hypot(x - p[0] - t * dx, y - p[1] - t * dy)

    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.array_min(F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), gap))


def ring_groups(rings: Column) -> Column:
    """Each ring's nesting depth among its polygon's rings: how many others hold its first point. Even depths are
    outlines, odd ones are holes."""
    inside = lambda r: F.aggregate(rings, F.lit(0), lambda n, other: n + F.when((other != r) & point_in_ring(r[0][0], r[0][1], other), 1).otherwise(0))
    return F.transform(rings, inside)


def cubic_points(p: list[Column], n: int = 16) -> Column:
    """n + 1 points along a cubic curve of four [x, y] points."""
    at = lambda t, k: (1 - t) ** 3 * p[0][k] + 3 * (1 - t) ** 2 * t * p[1][k] + 3 * (1 - t) * t**2 * p[2][k] + t**3 * p[3][k]
    return F.array(*[F.array(at(i / n, 0), at(i / n, 1)) for i in range(n + 1)])


def arc_points(x: Column, y: Column, r: Column, a0: Column, a1: Column, n: int = 32) -> Column:
    step = (a1 - a0) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.array(x + r * F.cos(a0 + i * step), y + r * F.sin(a0 + i * step)))


def label_box(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, x1, y0, y1) of a rotated label box around its centre."""
    c, s = F.abs(F.cos(rotation)), F.abs(F.sin(rotation))
    hw, hh = (width * c + height * s) / 2, (width * s + height * c) / 2
    return x - hw, x + hw, y - hh, y + hh


def upright(rotation: Column) -> Column:
    """A rotation turned by half a circle where text would stand on its head."""
    a = F.pmod(rotation, F.lit(2 * math.pi))
    return F.when((a > math.pi / 2) & (a < 3 * math.pi / 2), a - math.pi).otherwise(F.when(a >= 3 * math.pi / 2, a - 2 * math.pi).otherwise(a))


def trim_to_width(text: Column, width: Column, char_width: float) -> Column:
    """Text cut to a width with an ellipsis, at a fixed width per character."""
    room = F.floor(width / char_width).cast("int")
    return F.when(F.length(text) <= room, text).when(room <= 1, F.lit("")).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), room - 1)), F.lit("…")))


def arrow_head(x0: Column, y0: Column, x1: Column, y1: Column, size: float, half_width: float) -> Column:
    """Three [x, y] points of an arrow head at a link's end; null for a link of no length."""
    d = F.hypot(x1 - x0, y1 - y0)
    ux, uy = (x1 - x0) / d, (y1 - y0) / d
    bx, by = x1 - ux * size, y1 - uy * size
    return F.when(d > 0, F.array(F.array(x1, y1), F.array(bx - uy * half_width, by + ux * half_width), F.array(bx + uy * half_width, by - ux * half_width)))
