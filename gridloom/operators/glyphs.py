"""Glyph tables: what a graph's nodes and links, and a view's frontier, are drawn as.

A style is a constant, a Column over the table, or ``{"by": metric, "scale": function}``, the function being one of
Columns, so that a sum over a module's members goes through the same scale as a node's own value.

Edge cases: a null or NaN metric gives a null or NaN glyph column, never a dropped row; empty tables stay empty; ties
go to the larger position in paint order where one glyph is asked for, as it is drawn last.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.color import byte, hex_rgb, rgb_hex
from gridloom.operators.hierarchy import enclosing_modules
from gridloom.operators.styles import metric, share_border
from gridloom.operators.view import View, within

Scale = Callable[[Column], Column]
#: A glyph's border is its own fill times this, where it has no colour of its own.
DARKEN = 0.7


def node_radius(nodes: DataFrame, spec: Any) -> Column:
    """A constant, a column, a function of the degree, or a metric through a scale."""
    if isinstance(spec, dict):
        return spec["scale"](metric(nodes, spec["by"])).cast("double")
    if isinstance(spec, Column):
        return spec.cast("double")
    if callable(spec):
        return spec(metric(nodes, "degree")).cast("double")
    return F.lit(float(spec))


def radius_rule(nodes: DataFrame, spec: Any) -> tuple[Column, Scale] | None:
    """(a node's value, the scale of a sum of values) for sizes by a metric; None where sizes don't add up."""
    return (metric(nodes, spec["by"]).cast("double"), spec["scale"]) if isinstance(spec, dict) else None


def importance(nodes: DataFrame, spec: Any = None, radius: Any = 1.0) -> Column:
    """What survives where glyphs overlap: a metric, a column, or "order" (all alike); by default the size's metric."""
    if spec is None:
        spec = radius["by"] if isinstance(radius, dict) else "order"
    return F.lit(1.0) if isinstance(spec, str) and spec == "order" else metric(nodes, spec).cast("double")


def by_weight(spec: Any) -> Scale:
    """A link style as a function of a weight, so that it also takes the sum of the links of a super-edge."""
    if isinstance(spec, dict):
        return spec["scale"]
    if callable(spec) and not isinstance(spec, Column):
        return spec
    return lambda w: F.lit(spec)


def ramp(low: str, high: str, least: float, most: float) -> Scale:
    """A colour scale: #rrggbb between two colours, linear in each channel, cut at its ends."""
    a, b = ([int(c[k : k + 2], 16) for k in (1, 3, 5)] for c in (low, high))

    def color(v: Column) -> Column:
        t = F.least(F.greatest((v - least) / (most - least), F.lit(0.0)), F.lit(1.0))
        return rgb_hex(*[x + t * (y - x) for x, y in zip(a, b)])

    return color


def node_fill(nodes: DataFrame, spec: Any, fallback: str) -> Column:
    """A colour, a column of colours, a metric through a colour scale, or the fallback."""
    if isinstance(spec, dict):
        return spec["scale"](metric(nodes, spec["by"]))
    return spec if isinstance(spec, Column) else F.lit(spec if spec is not None else fallback)


def module_fill(records: DataFrame, colors: DataFrame, fallback: str) -> DataFrame:
    """(id, fill): the colour (path, color) of each node's innermost module, else the fallback."""
    of = enclosing_modules(records).select("id", F.col("module").alias("path")).join(colors, "path", "left")
    return of.select("id", F.coalesce("color", F.lit(fallback)).alias("fill"))


def darkened(fill: Column, factor: float = DARKEN) -> Column:
    """#rrggbb with each channel times a factor."""
    return rgb_hex(*[c * factor for c in hex_rgb(fill)])


def flow_border(nodes: DataFrame, flow: Any, scale: Scale | None = None, share: bool = False, color: str | None = None) -> DataFrame:
    """``nodes`` (radius, fill, maybe flow) with border_width and border_color.

    Absolute: the metric through ``scale``. Share: the ring covers ``flow`` over the node's own flow of its area.
    Without a metric no node has a ring. The ring's colour is the one given, else the fill darkened.
    """
    if flow is None:
        width = F.lit(None).cast("double")
    elif share:
        own = F.col("flow") if "flow" in nodes.columns else F.lit(None).cast("double")
        width = share_border(F.col("radius"), metric(nodes, flow).cast("double"), own)
    else:
        width = scale(metric(nodes, flow)).cast("double")
    return nodes.withColumns({"border_width": width, "border_color": F.lit(color) if color else darkened(F.col("fill"))})


def link_lines(edges: DataFrame, points: DataFrame, width: Any = 1.0, color: Any = "#999999", bend: float = 0.0, heads: bool = False) -> DataFrame:
    """(edge_id, x0, y0, x1, y1, width, color, bend): links (edge_id, source, target, weight) with their ends' positions
    (id, x, y). ``heads`` adds the target's ``radius``, at whose rim an arrow ends."""
    end = lambda c, k: points.select(F.col("id").alias(c), F.col("x").alias("x" + k), F.col("y").alias("y" + k), *([F.col("radius")] if heads and k == "1" else []))
    rows = edges.join(end("source", "0"), "source").join(end("target", "1"), "target")
    return rows.select("edge_id", "x0", "y0", "x1", "y1", by_weight(width)(F.col("weight")).cast("double").alias("width"), by_weight(color)(F.col("weight")).alias("color"), F.lit(float(bend)).alias("bend"), *(["radius"] if heads else []))


def half_arrows(edges: DataFrame, points: DataFrame, width: Any, color: Any, bend: float = 0.0) -> DataFrame:
    """``link_lines`` with both ends' radii and opposite_width: the width of the link the other way, 0 without one."""
    back = edges.groupBy(F.col("target").alias("source"), F.col("source").alias("target")).agg(F.min_by("weight", "edge_id").alias("back"))
    lines = link_lines(edges, points, width, color, bend)
    radius = lambda c, k: points.select(F.col("id").alias(c), F.col("radius").alias(k))
    other = F.when((F.col("source") != F.col("target")) & F.col("back").isNotNull(), by_weight(width)(F.col("back")).cast("double")).otherwise(0.0)
    rest = edges.join(back, ["source", "target"], "left").join(radius("source", "r0"), "source").join(radius("target", "r1"), "target")
    return lines.join(rest.select("edge_id", "r0", "r1", other.alias("opposite_width")), "edge_id")


def _drawn(largest: float | None) -> Column:
    """Leaves, and aggregates of one leaf, have their own radius; others at most ``largest``."""
    single = F.col("is_leaf") | (F.col("count") == 1)
    return F.col("radius") if largest is None else F.when(single, F.col("radius")).otherwise(F.least("radius", F.lit(float(largest))))


def frontier_circles(frontier: DataFrame, leaf_fill: str, aggregate_fill: str, largest: float | None = None, fade: Column | None = None) -> DataFrame:
    """(path, cx, cy, r, fill, alpha) of frontier nodes (path, is_leaf, cx, cy, radius, count, maybe color).

    A node's own colour comes first; ``fade`` (0 to 1) scales alpha while a module opens.
    """
    single = F.col("is_leaf") | (F.col("count") == 1)
    plain = F.when(single, F.lit(leaf_fill)).otherwise(F.lit(aggregate_fill))
    fill = F.coalesce("color", plain) if "color" in frontier.columns else plain
    alpha = byte(255 * fade) if fade is not None else F.lit(255)
    return frontier.select("path", "cx", "cy", _drawn(largest).alias("r"), fill.alias("fill"), alpha.alias("alpha"))


def frontier_halos(frontier: DataFrame, gap: float, width: float, opacity: float = 1.0, largest: float | None = None) -> DataFrame:
    """(path, cx, cy, r, border, alpha): a ring around each aggregate, ``gap`` outside it; ``border`` is the ring's share
    of the outer radius."""
    outer = _drawn(largest) + gap + width
    rows = frontier.filter(~(F.col("is_leaf") | (F.col("count") == 1)))
    return rows.select("path", "cx", "cy", outer.alias("r"), F.when(outer > 0, width / outer).otherwise(0.0).alias("border"), byte(F.lit(255.0 * opacity)).alias("alpha"))


def boundary_rings(boundaries: DataFrame, width: Any, view: View, screen: bool = True, opacity: float = 1.0) -> DataFrame:
    """(path, cx, cy, r, border, alpha) of expanded modules (path, cx, cy, extent) whose ring can be seen.

    Widths in pixels where ``screen``. No ring: a width or radius that isn't positive, or a view wholly inside it.
    """
    w = (width if isinstance(width, Column) else F.lit(float(width))) / (view.k if screen else 1.0)
    x0, x1, y0, y1 = view.world()
    fx = F.greatest(F.abs(x0 - F.col("cx")), F.abs(x1 - F.col("cx")))
    fy = F.greatest(F.abs(y0 - F.col("cy")), F.abs(y1 - F.col("cy")))
    inner = F.col("extent") - w
    seen = (w > 0) & (F.col("extent") > 0) & ((inner <= 0) | (fx * fx + fy * fy >= inner * inner))
    return boundaries.filter(seen).select("path", "cx", "cy", F.col("extent").alias("r"), F.least(w / F.col("extent"), F.lit(1.0)).alias("border"), byte(F.lit(255.0 * opacity)).alias("alpha"))


def pick_frontier(frontier: DataFrame, px: float, py: float, view: View, screen_sized: bool = True, largest: float | None = None) -> DataFrame:
    """(path): the last frontier node (pos, path, is_leaf, cx, cy, radius, count) whose drawn circle holds a screen point."""
    leaf = F.col("radius") if largest is None else F.when(F.col("is_leaf"), F.col("radius")).otherwise(F.least("radius", F.lit(float(largest))))
    r = leaf if screen_sized else leaf * view.k
    dx, dy = px - (F.col("cx") * view.k + view.x), py - (F.col("cy") * view.k + view.y)
    return frontier.filter(~F.isnan("cx") & ~F.isnan("cy") & (dx * dx + dy * dy <= r * r)).agg(F.max_by("path", "pos").alias("path"))


def project_points(rows: DataFrame, key: str, x: Column, y: Column, radius: Column | float = 1.0, fill: Column | str = "#000000") -> DataFrame:
    """(id, x, y, radius, fill): rows through accessors; a null position culls the row."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    c = fill if isinstance(fill, Column) else F.lit(fill)
    out = rows.select(F.col(key).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), r.cast("double").alias("radius"), c.alias("fill"))
    return out.filter("x is not null and y is not null")


def gather(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``points`` that ``ids`` (id) names, once each."""
    return points.join(ids.select("id"), "id", "left_semi")


#: Points of a cell of the candidate grid, on average.
CELL_POINTS = 16


def candidate_grid(points: DataFrame) -> tuple[DataFrame, tuple[float, float, float, float]]:
    """``points`` with gx and gy, cells of a uniform grid over their box, and (x0, y0, width, height) of a cell.

    Written partitioned or bucketed by its cells, the table is read in part by :func:`candidates`.
    """
    finite = points.filter(~F.isnan("x") & ~F.isnan("y"))
    n, x0, x1, y0, y1 = finite.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    flat = not n or not (x1 > x0) or not (y1 > y0)
    side = 1 if flat else max(1, -int(-((n / CELL_POINTS) ** 0.5) // 1))
    cell = (x0 or 0.0, y0 or 0.0, 1.0 if flat else (x1 - x0) / side, 1.0 if flat else (y1 - y0) / side)
    at = lambda c, low, step: F.least(F.greatest(F.coalesce(F.floor((F.nanvl(F.col(c), F.lit(low)) - low) / step), F.lit(0)), F.lit(0)), F.lit(side - 1)).cast("int")
    return points.withColumns({"gx": at("x", cell[0], cell[2]), "gy": at("y", cell[1], cell[3])}), cell


def candidates(grid: DataFrame, cell: tuple[float, float, float, float], view: View) -> DataFrame:
    """(id) of the points in a view, in ascending order: the cells that meet the view, then the exact test."""
    x0, x1, y0, y1 = view.world()
    low = lambda v, o, s: int((v - o) // s) - 1
    high = lambda v, o, s: int((v - o) // s) + 1
    ox, oy, w, h = cell
    edge = grid.agg(F.max("gx"), F.max("gy")).first()
    gx = F.col("gx").between(min(low(x0, ox, w), edge[0] or 0), max(0, high(x1, ox, w)))
    gy = F.col("gy").between(min(low(y0, oy, h), edge[1] or 0), max(0, high(y1, oy, h)))
    return grid.filter(gx & gy).filter(within(F.col("x"), F.col("y"), view.world())).select("id").orderBy("id")


def lod_spacing(declutter: bool = True, spacing: float = 2.0) -> float:
    """How many times its size a glyph counts in a cut: the declutter's spacing if that thins at all, else 1."""
    return spacing if declutter and 1 < spacing < float("inf") else 1.0


def segment_reduce(rows: DataFrame, segment: str, value: str) -> DataFrame:
    """(segment, sum, min, max, n) of a value per segment; null values don't count."""
    v = F.col(value)
    return rows.groupBy(F.col(segment).alias("segment")).agg(F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def live_update(nodes: DataFrame, flow: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """``nodes`` (id, x, y, selected, flow, path) under new flow (id, flow) and module paths (id, path).

    Positions and the selection stay; a node that the new values leave out keeps its old ones.
    """
    for name, given in (("flow", flow), ("path", modules)):
        if given is not None:
            new = given.select("id", F.col(name).alias("__new"))
            nodes = nodes.join(new, "id", "left").withColumn(name, F.coalesce("__new", name)).drop("__new")
    return nodes


def hold_pinned(moved: DataFrame, before: DataFrame, pinned: DataFrame) -> DataFrame:
    """(id, x, y, vx, vy) after a tick in which ``pinned`` (id) stay where they were, at rest."""
    was = before.select("id", F.col("x").alias("wx"), F.col("y").alias("wy")).join(pinned.select("id").distinct(), "id", "left_semi")
    held = F.col("wx").isNotNull()
    keep = lambda c, w: F.when(held, w).otherwise(F.col(c)).alias(c)
    return moved.join(was, "id", "left").select("id", keep("x", F.col("wx")), keep("y", F.col("wy")), keep("vx", F.lit(0.0)), keep("vy", F.lit(0.0)))


def declutter_anchored(glyphs: DataFrame, view: View, exclusion: float) -> DataFrame:
    """(id): glyphs (id, ord, ax, ay) whose anchor is kept; glyphs on one anchor stand or fall together.

    Anchors go in order of their first glyph; ``exclusion`` is the least distance of two, in pixels. Glyphs without an
    anchor are kept, and all are where nothing is excluded.
    """
    from gridloom.operators.declutter import declutter

    if not exclusion > 0:
        return glyphs.select("id")
    anchored = glyphs.filter("ax is not null and ay is not null")
    spots = anchored.groupBy("ax", "ay").agg(F.min("ord").alias("id"))
    kept = declutter(spots.select("id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(exclusion / 2).alias("radius")), view, 1.0)
    shown = spots.join(kept, "id", "left_semi").select("ax", "ay")
    return anchored.join(shown, ["ax", "ay"], "left_semi").select("id").union(glyphs.filter("ax is null or ay is null").select("id"))
