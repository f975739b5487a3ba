"""Links lifted along a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.hierarchy import closure


def common_depth(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two paths."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull() & y.isNotNull())
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]


def super_edges(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, flow) by path: flow of links between branches, at every level, and from a shallower end to
    each deeper ancestor of the other.

    One explode of at most (depth of the paths) rows per link and one map-side combined aggregation; there is no
    recursion.
    """
    at = lambda c, p: records.select(F.col("id").alias(c), F.col("path").alias(p))
    e = edges.filter("source <> target").join(at("source", "pu"), "source").join(at("target", "pv"), "target")
    return lifted(e.select("pu", "pv", F.col("weight").alias("flow")))


def lifted(pairs: DataFrame) -> DataFrame:
    """The same from pairs of paths (pu, pv, flow); a pair of a node and its ancestor has no part in it."""
    du, dv = F.size("pu"), F.size("pv")
    e = pairs.withColumn("lca", common_depth(F.col("pu"), F.col("pv"))).filter((F.col("lca") < du) & (F.col("lca") < dv))
    level = F.transform(F.sequence(F.col("lca") + 1, F.least(du, dv)), lambda d: F.struct(F.slice("pu", 1, d).alias("source"), F.slice("pv", 1, d).alias("target")))
    none = F.array().cast("array<struct<source:array<bigint>,target:array<bigint>>>")
    left = F.when(du > dv, F.transform(F.sequence(F.least(dv + 1, du), du), lambda d: F.struct(F.slice("pu", 1, d).alias("source"), F.col("pv").alias("target")))).otherwise(none)
    right = F.when(dv > du, F.transform(F.sequence(F.least(du + 1, dv), dv), lambda d: F.struct(F.col("pu").alias("source"), F.slice("pv", 1, d).alias("target")))).otherwise(none)
    return e.select("flow", F.explode(F.concat(level, left, right)).alias("p")).groupBy("p.source", "p.target").agg(F.sum("flow").alias("flow"))


def module_link_rows(links: DataFrame) -> DataFrame:
    """(source, target, flow): module links (src, dst, flow) by their own ends; nested pairs dropped, equal summed."""
    c = common_depth(F.col("src"), F.col("dst"))
    return links.filter((c < F.size("src")) & (c < F.size("dst"))).groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.sum("flow").alias("flow"))


def resolve_paths(asked: DataFrame, records: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, node): the module of each path, else the leaf; a path of neither raises, naming it."""
    found = asked.join(tree.select("path", "node"), "path", "left").join(records.select("path", "id"), "path", "left")
    node = F.coalesce("node", "id")
    return found.select("path", F.when(node.isNotNull(), node).otherwise(F.raise_error(F.concat(F.lit("no module or node at path "), F.array_join("path", ":"))).cast("long")).alias("node"))


def nearest_present(records: DataFrame, present: DataFrame) -> DataFrame:
    """(id, present): the deepest module above each node that is in ``present`` (path)."""
    up = closure(records).join(present.select(F.col("path").alias("prefix")), "prefix")
    return up.groupBy("id").agg(F.max_by("prefix", "depth").alias("present"))
