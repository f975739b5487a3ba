"""Colours as column expressions: HCL (CIE LCh) to sRGB and back, CSS text, composition, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The D50 white point, CIE Lab constants and the sRGB matrices.
WHITE = (0.96422, 1.0, 0.82521)
LAB_0, LAB_1 = 4 / 29, 6 / 29
TO_RGB = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
TO_XYZ = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))


def _lab_inverse(t: Column) -> Column:
    return F.when(t > LAB_1, t * t * t).otherwise(3 * LAB_1 * LAB_1 * (t - LAB_0))


def _lab(t: Column) -> Column:
    return F.when(t > LAB_1**3, F.pow(t, F.lit(1 / 3))).otherwise(t / (3 * LAB_1 * LAB_1) + LAB_0)


def _companded(x: Column) -> Column:
    return 255 * F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(F.greatest(x, F.lit(1e-12)), F.lit(1 / 2.4)) - 0.055)


def _linear(c: Column) -> Column:
    x = c / 255
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def hcl_to_rgb(h: Column, c: Column, l: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """sRGB channels, not rounded or clamped; the hue is in degrees."""
    a, b = F.cos(F.radians(h)) * c, F.sin(F.radians(h)) * c
    fy = (l + 16) / 116
    xyz = [w * _lab_inverse(f) for w, f in zip(WHITE, (fy + a / 500, fy, fy - b / 200))]
    return tuple(_companded(sum(m * v for m, v in zip(row, xyz))) for row in TO_RGB)


def rgb_to_hcl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = [_linear(x) for x in (r, g, b)]
    x, y, z = (_lab(sum(m * v for m, v in zip(row, rgb)) / w) for row, w in zip(TO_XYZ, WHITE))
    la, aa, bb = 116 * y - 16, 500 * (x - y), 200 * (y - z)
    return F.pmod(F.degrees(F.atan2(bb, aa)), F.lit(360.0)), F.hypot(aa, bb), la


def byte(x: Column) -> Column:
    """Rounded and clamped to a channel."""
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(byte(x).cast("long")), 2, "0") for x in (r, g, b)]))


def hcl_hex(h: Column, c: Column, l: Column) -> Column:  # noqa: E741
    return rgb_hex(*hcl_to_rgb(h, c, l))


def hex_rgb(text: Column) -> tuple[Column, Column, Column]:
    """Channels of #rgb or #rrggbb."""
    t = F.when(F.length(text) == 4, F.regexp_replace(text, "([0-9a-fA-F])", "$1$1")).otherwise(text)
    return tuple(F.conv(F.substring(t, k, 2), 16, 10).cast("int") for k in (2, 4, 6))


def packed(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.shiftleft(a.cast("long"), 24).bitwiseOR(F.shiftleft(b.cast("long"), 16)).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(r.cast("long"))


def composed_alpha(alpha: Column, opacity: Column) -> Column:
    """Alpha times opacity, clamped to a channel."""
    return byte(alpha * F.least(F.greatest(F.coalesce(opacity, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))


def pick_color(i: Column) -> tuple[Column, Column, Column]:
    """Channels that encode a drawable's number; 0 is nothing."""
    k = i + 1
    return k.bitwiseAND(255), F.shiftright(k, 8).bitwiseAND(255), F.shiftright(k, 16).bitwiseAND(255)


def picked_id(r: Column, g: Column, b: Column) -> Column:
    return r + 256 * g + 65536 * b - 1


def shifted(h: Column, c: Column, l: Column, match: Column, hue: float, least_chroma: float) -> tuple[Column, Column, Column]:  # noqa: E741
    """HCL of matches with a new hue and at least some chroma, lightness kept; others unchanged."""
    return F.when(match, F.lit(hue)).otherwise(h), F.when(match, F.greatest(c, F.lit(least_chroma))).otherwise(c), l
