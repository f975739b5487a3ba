"""Morton codes and cells as column expressions over longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16


def spread(v: Column) -> Column:
    """The low 16 bits of v, each followed by a zero bit."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def squeeze(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x55555555).cast("long"))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def interleave(qx: Column, qy: Column) -> Column:
    return spread(qx.cast("long")).bitwiseOR(F.shiftleft(spread(qy.cast("long")), 1))


def prefix(code: Column, level: Column | int) -> Column:
    """The code's first ``level`` pairs of bits, the rest zero."""
    level = F.lit(level) if isinstance(level, int) else level
    size = F.pow(F.lit(4.0), F.lit(BITS) - level).cast("long")
    return (code - code % size).cast("long")


def common_level(a: Column, b: Column) -> Column:
    """How many leading pairs of bits two codes share."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, BITS).otherwise(F.lit(BITS) - F.floor((F.length(F.bin(x)) + 1) / 2)).cast("int")


def root_box(points: DataFrame) -> tuple[float, float, float]:
    """(x0, y0, side): a square whose side is a power of two and whose corner lies on a quarter grid, with room of
    a third around finite points."""
    ok = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    r = points.filter(ok).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if r[0] is None:
        return 0.0, 0.0, 1.0
    import math

    span = max(r[1] - r[0], r[3] - r[2], 1e-9)
    side = 2.0 ** math.ceil(math.log2(span * 4 / 3))
    grid = side / 4
    return math.floor(r[0] / grid) * grid, math.floor(r[2] / grid) * grid, side


def quantized(points: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """``points`` with their Morton code in a box; points that aren't finite go to its corner."""
    x0, y0, side = box
    top = (1 << BITS) - 1

    def q(c: str, low: float) -> Column:
        cell = F.floor((F.col(c) - low) / side * (1 << BITS))
        return F.when(F.isnan(c), 0).otherwise(F.least(F.greatest(cell, F.lit(0)), F.lit(top))).cast("long")

    return points.withColumn("code", interleave(q("x", x0), q("y", y0)))
