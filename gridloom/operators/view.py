"""View queries: what a (k, x, y, width, height) view shows, hits and labels. screen = world * k + (x, y)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.hierarchy import closure


@dataclass(frozen=True)
class View:
    k: float
    x: float
    y: float
    width: float
    height: float

    def world(self) -> tuple[float, float, float, float]:
        """(x0, x1, y0, y1) of the visible world."""
        return -self.x / self.k, (self.width - self.x) / self.k, -self.y / self.k, (self.height - self.y) / self.k


def within(x: Column, y: Column, rect: tuple[float, float, float, float]) -> Column:
    """In a closed rectangle; NaN is outside."""
    x0, x1, y0, y1 = rect
    return x.between(x0, x1) & y.between(y0, y1) & ~F.isnan(x) & ~F.isnan(y)


def in_view(points: DataFrame, view: View) -> DataFrame:
    return points.filter(within(F.col("x"), F.col("y"), view.world()))


def pick_nodes(points: DataFrame, px: float, py: float, view: View, screen_sized: bool = True) -> DataFrame:
    """(id): the last node whose circle holds a screen point."""
    r = F.col("radius") if screen_sized else F.col("radius") * view.k
    dx, dy = F.col("x") * view.k + view.x - px, F.col("y") * view.k + view.y - py
    return points.filter(~F.isnan("x") & ~F.isnan("y") & (dx * dx + dy * dy <= r * r)).agg(F.max("id").alias("id"))


def region_nodes(points: DataFrame, rect: tuple[float, float, float, float], view: View) -> DataFrame:
    """(id): nodes whose centre lies in a screen rectangle (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = rect
    world = ((min(x0, x1) - view.x) / view.k, (max(x0, x1) - view.x) / view.k, (min(y0, y1) - view.y) / view.k, (max(y0, y1) - view.y) / view.k)
    return points.filter(within(F.col("x"), F.col("y"), world)).select("id")


def pick_ring(rings: DataFrame, px: float, py: float, view: View, min_hit: float = 6.0) -> DataFrame:
    """(ring): of boundary rings (ring, cx, cy, r, w, alpha, depth, pos) under a screen point the deepest, then the last."""
    wx, wy = (px - view.x) / view.k, (py - view.y) / view.k
    pad = F.greatest((F.lit(min_hit / view.k) - F.col("w")) / 2, F.lit(0.0))
    d = F.hypot(F.col("cx") - wx, F.col("cy") - wy)
    hit = (d >= F.greatest(F.col("r") - F.col("w") - pad, F.lit(0.0))) & (d <= F.col("r") + pad) & (F.col("alpha") > 0)
    return rings.filter(hit).agg(F.max_by("ring", F.struct("depth", "pos")).alias("ring"))


def default_expand_px(leaf_branching: float, width: float, height: float) -> float:
    """max(48, min(48 * sqrt(branching / 2), half the smaller side))."""
    return max(48.0, min(48.0 * (leaf_branching / 2) ** 0.5, 0.5 * min(width, height)))


def cut(records: DataFrame, modules: DataFrame, points: DataFrame, view: View, expand_px: float, draw_radius: float = 0.0) -> DataFrame:
    """(path, is_leaf): the frontier of a view.

    A module expands if its extent on screen, 2 * extent * k, reaches ``expand_px``; it is visible unless its box of
    extent + draw radius misses the view. The frontier is what is visible, a leaf or not expanded, and has only
    visible and expanded modules above it: an anti-join of the closure against the modules that stop a descent.
    Modules are (path, cx, cy, extent); ``draw_radius`` is in pixels.
    """
    x0, x1, y0, y1 = view.world()
    pad = draw_radius / view.k

    def culled(x: Column, y: Column, e: Column) -> Column:  # NaN compares false: not culled
        half = e + pad
        out = (x + half < x0) | (x - half > x1) | (y + half < y0) | (y - half > y1)
        return F.when(F.isnan(x) | F.isnan(y), False).otherwise(out)

    m = modules.select("path", culled(F.col("cx"), F.col("cy"), F.col("extent")).alias("culled"), (2 * F.col("extent") * view.k >= expand_px).alias("expands"))
    stops = m.filter("culled or not expands").select(F.col("path").alias("prefix"))
    leaves = records.join(points, "id").filter(~culled(F.col("x"), F.col("y"), F.lit(0.0))).select("id", "path")
    blocked = closure(leaves.select("id", "path")).join(stops, "prefix", "left_semi").select("id").distinct()
    shown = leaves.join(blocked, "id", "left_anti").select("path", F.lit(True).alias("is_leaf"))
    candidates = m.filter("not culled and not expands").select("path")
    chain = candidates.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.size("path") - 1, F.lit(0)))).alias("d")).filter("d < size(path)").withColumn("prefix", F.slice("path", 1, F.col("d")))
    hidden = chain.join(stops, "prefix", "left_semi").select("path").distinct()
    return shown.unionByName(candidates.join(hidden, "path", "left_anti").select("path", F.lit(False).alias("is_leaf")))


def expanded_boundaries(modules: DataFrame, view: View, expand_px: float) -> DataFrame:
    """(path): expanded modules, the root excluded, whose circle (cx, cy, extent) meets the view."""
    x0, x1, y0, y1 = view.world()
    dx = F.greatest(x0 - F.col("cx"), F.col("cx") - x1, F.lit(0.0))
    dy = F.greatest(y0 - F.col("cy"), F.col("cy") - y1, F.lit(0.0))
    return modules.filter((F.size("path") > 0) & (2 * F.col("extent") * view.k >= expand_px) & (F.hypot(dx, dy) <= F.col("extent"))).select("path")


def top_labels(points: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the highest key, ties to smaller ids; NaN keys come last."""
    k = F.when(F.isnan(key), float("-inf")).otherwise(F.col(key))
    return points.orderBy(k.desc(), "id").limit(n)


def fit_transform(box: DataFrame, width: float, height: float, pad: float = 0.0) -> DataFrame:
    """(k, x, y) that fits a box (x0, x1, y0, y1) into 85 % of the smaller side."""
    room = 0.85 * min(width, height)
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    k = F.lit(max(room - 2 * pad, room / 2)) / span
    return box.withColumn("k", k).select("k", (width / 2 - F.col("k") * (F.col("x0") + F.col("x1")) / 2).alias("x"), (height / 2 - F.col("k") * (F.col("y0") + F.col("y1")) / 2).alias("y"))


def interpolate_view(a: View, b: View, t: float) -> View:
    """Linear in 1/k, x/k and y/k."""
    inv = (1 - t) / a.k + t / b.k
    k = 1 / inv
    return View(k, ((1 - t) * a.x / a.k + t * b.x / b.k) * k, ((1 - t) * a.y / a.k + t * b.y / b.k) * k, b.width, b.height)


def clear_zoom(d: Column, a: Column, b: Column, screen: bool) -> Column:
    """The zoom from which two circles at distance d don't touch; infinity where there is none."""
    endless = F.lit(float("inf"))
    if screen:
        return F.when(d > 0, (F.greatest(a, F.lit(0.5)) + F.greatest(b, F.lit(0.5))) / d).otherwise(endless)
    big = F.greatest(a, b)
    return F.when(d < a + b, endless).when(d >= 2 * big, 1 / d).otherwise(0.5 / (d - big))


def crowding(records: DataFrame, points: DataFrame, spacing: float = 2.0) -> DataFrame:
    """(module, clear_zoom): per innermost module the highest clear zoom of its pairs of members,
    on screen-sized radii.

    With radii in [r0, r1] a pair at distance d needs a zoom in [2 r0 / d, 2 r1 / d] * spacing: only
    pairs within ``r1 / r0`` times a module's closest distance can be the highest. That distance is bounded by the
    pairs in neighbouring cells of a grid on the module, so that the join is by (module, cell), never all pairs.
    """
    at = records.select("id", F.slice("path", 1, F.size("path") - 1).alias("module")).join(points, "id").select("id", "module", "x", "y", (F.col("radius") * spacing).alias("r"))
    stats = at.groupBy("module").agg(F.count("*").alias("n"), F.max("x").alias("xm"), F.min("x").alias("xi"), F.max("y").alias("ym"), F.min("y").alias("yi"), F.max("r").alias("rm"), F.min("r").alias("ri"))
    # among n points in an area A two lie within sqrt(2 A) / sqrt(n - 1) or along the longer side
    span = F.greatest(F.col("xm") - F.col("xi"), F.col("ym") - F.col("yi"), F.lit(1e-9))
    near = span * F.sqrt(F.lit(2.0)) / F.floor(F.sqrt(F.greatest(F.col("n") - 1, F.lit(1)).cast("double")))
    stats = stats.select("module", (near * F.greatest(F.col("rm") / F.greatest("ri", F.lit(0.5)), F.lit(1.0))).alias("h"))
    c = at.join(stats, "module").withColumns({"gx": F.floor(F.col("x") / F.col("h")), "gy": F.floor(F.col("y") / F.col("h"))})
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(gx + i as gx, gy + j as gy))))"))
    other = c.select(F.col("id").alias("id2"), "module", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("r").alias("r2"), around.alias("g")).select("id2", "module", "x2", "y2", "r2", "g.gx", "g.gy")
    pairs = c.join(other, ["module", "gx", "gy"]).filter("id < id2")
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return pairs.groupBy("module").agg(F.max(clear_zoom(d, F.col("r"), F.col("r2"), True)).alias("clear_zoom"))
