"""Measures rolled up along a hierarchy: sums over the closure in one aggregation, extents and hues level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.hierarchy import closure
from gridloom.plans.storage import stored


def leaf_counts(records: DataFrame) -> DataFrame:
    return closure(records).groupBy(F.col("prefix").alias("path")).agg(F.count("*").alias("leaves"))


def _finite(c: str):
    return F.when(~F.isnan(c), F.col(c))


def positions(records: DataFrame, points: DataFrame) -> DataFrame:
    """(path, depth, leaves, cx, cy, x0, x1, y0, y1, extent) of every module.

    Count, centroid and box are one aggregation over the closure. The extent is the least of the box's corner
    distance and the bound that the children give, which takes a pass per level, each over modules alone.
    NaN positions count as no position.
    """
    at = closure(records).join(points.select("id", _finite("x").alias("x"), _finite("y").alias("y")), "id")
    n = at.groupBy(F.col("prefix").alias("path"), "depth").agg(F.count("*").alias("leaves"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corner = F.hypot(F.greatest(F.col("cx") - F.col("x0"), F.col("x1") - F.col("cx")), F.greatest(F.col("cy") - F.col("y0"), F.col("y1") - F.col("cy")))
    n = stored(n.withColumn("corner", corner), "positions")
    last = n.agg(F.max("depth")).first()[0]
    if last is None:
        return n.withColumn("extent", F.lit(0.0)).drop("corner")
    leaves = records.join(points, "id").select(F.slice("path", 1, F.size("path") - 1).alias("up"), F.col("x").alias("kx"), F.col("y").alias("ky"), F.lit(0.0).alias("ke"))
    levels: list[DataFrame] = []
    for depth in range(last, -1, -1):
        kids = leaves.filter(F.size("up") == depth)
        if levels:
            kids = kids.unionByName(levels[-1].select(F.slice("path", 1, depth).alias("up"), F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.col("extent").alias("ke")))
        here = n.filter(F.col("depth") == depth)
        reach = here.join(kids, here.path == kids.up).groupBy("path").agg(F.max(F.hypot(F.col("kx") - F.col("cx"), F.col("ky") - F.col("cy")) + F.col("ke")).alias("reach"))
        levels.append(stored(here.join(reach, "path", "left").withColumn("extent", F.least("corner", F.coalesce("reach", "corner"))).drop("reach", "corner"), "level"))
    return reduce(DataFrame.unionByName, levels)


def style(records: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, radius, weight): the root of summed squares of radii, the sum of weights; leaves is (id, radius, weight)."""
    return closure(records).join(leaves, "id").groupBy(F.col("prefix").alias("path")).agg(F.sqrt(F.sum(F.col("radius") * F.col("radius"))).alias("radius"), F.sum("weight").alias("weight"))


def subtree_weights(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, weight): sums of ``size`` with NaN and negatives as 0."""
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(0)
    size = F.when(F.isnan(F.col("size").cast("double")), 0).otherwise(size)
    return closure(records).join(sizes.select("id", size.alias("size")), "id").groupBy(F.col("prefix").alias("path")).agg(F.sum("size").alias("weight"))


def border_values(records: DataFrame, leaves: DataFrame, given: DataFrame) -> DataFrame:
    """(path, border): the sum of the leaves' border, or the value ``given`` (path, given) for that module alone."""
    sums = closure(records).join(leaves, "id").groupBy(F.col("prefix").alias("path")).agg(F.sum("border").alias("border"))
    return sums.join(given, "path", "left").select("path", F.coalesce("given", "border").alias("border"))


def update_positions(records: DataFrame, modules: DataFrame, points: DataFrame, moved: DataFrame) -> DataFrame:
    """``modules`` after some leaves ``moved`` (id, x, y): exact centroids by differences, extents that only grow.

    Only the moved leaves' chains are touched.
    """
    old = points.select("id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    shift = closure(records.join(moved.select("id"), "id", "left_semi")).select("id", "prefix").join(moved, "id").join(old, "id")
    d = shift.groupBy(F.col("prefix").alias("path")).agg(F.sum(F.col("x") - F.col("ox")).alias("dx"), F.sum(F.col("y") - F.col("oy")).alias("dy"))
    out = modules.join(d, "path", "left").fillna(0.0, ["dx", "dy"]).withColumns({"nx": F.col("cx") + F.col("dx") / F.col("leaves"), "ny": F.col("cy") + F.col("dy") / F.col("leaves")})
    grown = shift.join(out.select(F.col("path").alias("prefix"), "nx", "ny"), "prefix").groupBy(F.col("prefix").alias("path")).agg(F.max(F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).alias("far"))
    kept = F.col("extent") + F.hypot(F.col("nx") - F.col("cx"), F.col("ny") - F.col("cy"))
    return out.join(grown, "path", "left").select("path", "depth", "leaves", F.col("nx").alias("cx"), F.col("ny").alias("cy"), F.greatest(kept, F.coalesce("far", F.lit(0.0))).alias("extent"))


def hue_means(records: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, depth, h, c, l): per module the chroma-weighted circular mean hue and the plain mean chroma and
    lightness of its direct children; leaves is (id, h, c, l), hues in degrees."""
    depth = records.agg(F.max(F.size("path"))).first()[0]
    kids = records.join(leaves, "id").select("path", "h", "c", "l")
    done: list[DataFrame] = []
    for k in range((depth or 1) - 1, -1, -1):
        here = kids.filter(F.size("path") == k + 1)
        if done:
            here = here.unionByName(done[-1].select("path", "h", "c", "l"))
        rad = F.radians("h")
        mean = here.groupBy(F.slice("path", 1, k).alias("path")).agg(F.degrees(F.atan2(F.sum(F.sin(rad) * F.col("c")), F.sum(F.cos(rad) * F.col("c")))).alias("h"), F.avg("c").alias("c"), F.avg("l").alias("l"))
        done.append(stored(mean.withColumn("depth", F.lit(k)), "hues"))
    return reduce(DataFrame.unionByName, done)
