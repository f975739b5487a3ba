"""Label boxes: sizes of text, boxes that run from an anchor, rotation, upright flips, overlap. Column expressions.

A box is (x, y, width, height, rotation, text_anchor, baseline, keep_upright); a null rotation means a plain box, which
runs right and down from its anchor unless text_anchor ("start", "middle", "end") and baseline ("top", "middle") say
otherwise. A rotated box is centred on its axis. Null sizes count as zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of a character as a share of the font's size where nothing measures text, and the height of a row.
CHAR, ROW = 0.55, 1.25


def font_px(font: Column) -> Column:
    """The pixel size in a CSS font; 12 without one."""
    return F.coalesce(F.regexp_extract(font, r"(\d+(?:\.\d+)?)px", 1).try_cast("double"), F.lit(12.0))


def canvas_font(font: Column) -> Column:
    """A CSS font without its line height."""
    return F.regexp_replace(font, r"(\d+(?:\.\d+)?px)\s*/\s*[^\s,]+", "$1")


def measure(text: Column, font: Column) -> tuple[Column, Column]:
    """(width, height) in pixels, rounded up, from the number of UTF-16 units."""
    px = font_px(font)
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.ceil(units * (px * CHAR)).cast("long"), F.ceil(px * ROW).cast("long")


def _flip(rotation: Column, keep_upright: Column) -> Column:
    return F.coalesce(rotation.isNotNull() & keep_upright & (F.cos(rotation) < 0), F.lit(False))


def rendered(rotation: Column, anchor: Column, keep_upright: Column) -> tuple[Column, Column]:
    """(rotation, anchor) as drawn: text that would read upside down turns about and swaps its side."""
    flip = _flip(rotation, keep_upright)
    side = F.coalesce(anchor, F.lit("start"))
    swapped = F.when(side == "start", "end").when(side == "end", "start").otherwise("middle")
    return F.coalesce(F.when(flip, rotation + math.pi).otherwise(rotation), F.lit(0.0)), F.when(flip, swapped).otherwise(side)


def corners(x: Column, y: Column, width: Column, height: Column, rotation: Column, anchor: Column, baseline: Column, keep_upright: Column) -> Column:
    """The box's four corners as an array of structs (x, y), from its own upper left one."""
    w, h = F.coalesce(width, F.lit(0.0)), F.coalesce(height, F.lit(0.0))
    angle, side = rendered(rotation, anchor, keep_upright)
    left = F.when(side == "start", 0.0).when(side == "end", -w).otherwise(-w / 2)
    top = F.when(rotation.isNotNull() | F.coalesce(baseline == "middle", F.lit(False)), -h / 2).otherwise(0.0)
    c, s = F.cos(angle), F.sin(angle)
    at = lambda u, v: F.struct((x + u * c - v * s).alias("x"), (y + u * s + v * c).alias("y"))
    return F.array(at(left, top), at(left + w, top), at(left + w, top + h), at(left, top + h))


def bounds(quad: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, x1, y0, y1) of corners."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def overlap(cx: Column, cy: Column, hw: Column, hh: Column, angle: Column, ox: Column, oy: Column, ow: Column, oh: Column, other: Column) -> Column:
    """Whether two boxes of given centres, half sizes and angles share more than an edge: no axis of either separates
    them."""
    dx, dy = ox - cx, oy - cy

    def apart(ux: Column, uy: Column) -> Column:
        reach = lambda w, h, a: w * F.abs(F.cos(a) * ux + F.sin(a) * uy) + h * F.abs(F.cos(a) * uy - F.sin(a) * ux)
        return F.abs(dx * ux + dy * uy) >= reach(hw, hh, angle) + reach(ow, oh, other)

    axes = [(F.cos(a), F.sin(a)) for a in (angle, other)]
    out = F.lit(False)
    for c, s in axes:
        out = out | apart(c, s) | apart(-s, c)
    return ~out
