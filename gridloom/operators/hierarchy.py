"""Module hierarchies from paths: closure, tree, colours, selections.

A record is (id, path): the module chain from the top and, last, the node's rank in its module. All that walks a
tree elsewhere is here an explode of path prefixes and one aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.storage import dense_index


def closure(records: DataFrame) -> DataFrame:
    """(id, path, depth, prefix): a row for every module above a node, the root (depth 0) included."""
    at = records.select("*", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("depth"))
    return at.withColumn("prefix", F.slice("path", 1, F.col("depth")))


def module_tree(records: DataFrame) -> DataFrame:
    """(node, path, depth, height, level, first_record, leaves, branch): one row per module.

    A module's height is the longest path below it, level ids follow height, then first record, then depth, and
    lie above the leaves' ids, so that children always have smaller ids.
    """
    modules = closure(records).groupBy(F.col("prefix").alias("path"), "depth").agg((F.max(F.size("path")) - F.col("depth")).alias("height"), F.min("id").alias("first_record"), F.count("*").alias("leaves"))
    n = records.count()
    numbered = dense_index(modules, ["height", "first_record", "depth"], "node", start=n)
    return numbered.select("node", "path", "depth", "height", F.col("height").alias("level"), "first_record", "leaves", F.when(F.col("depth") > 0, F.element_at("path", -1)).alias("branch"))


def tree_nodes(records: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, parent, level, branch, is_leaf) of leaves and modules; the root's parent is null."""
    up = tree.select(F.col("path").alias("up"), F.col("node").alias("parent"))
    above = lambda p: F.slice(p, 1, F.size(p) - 1)
    leaves = records.select(F.col("id").alias("node"), above("path").alias("up"), F.lit(0).alias("level"), F.element_at("path", -1).alias("branch"), F.lit(True).alias("is_leaf"))
    modules = tree.select("node", F.when(F.col("depth") > 0, F.slice("path", 1, F.greatest(F.col("depth") - 1, F.lit(0)))).alias("up"), F.col("height").cast("int").alias("level"), "branch", F.lit(False).alias("is_leaf"))
    return leaves.unionByName(modules).join(up, "up", "left").select("node", "parent", "level", "branch", "is_leaf")


def enclosing_modules(records: DataFrame) -> DataFrame:
    """(id, module): the path of the module right above each node."""
    return records.select("id", F.slice("path", 1, F.size("path") - 1).alias("module"))


def leaves_under(records: DataFrame, path: list[int]) -> DataFrame:
    """(id): the nodes below a module, by path prefix."""
    want = F.array(*[F.lit(p).cast("long") for p in path]) if path else F.array().cast("array<bigint>")
    return records.filter((F.size("path") > len(path)) & (F.slice("path", 1, len(path)) == want)).select("id")


def selection_holders(records: DataFrame, selected: DataFrame) -> DataFrame:
    """(path): the modules strictly above any selected node (id)."""
    return closure(records.join(selected, "id", "left_semi")).select(F.col("prefix").alias("path")).distinct()


def ancestor_selected(records: DataFrame, nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """(id): nodes that are selected or lie below a selected module (path)."""
    below = closure(records).join(modules.select(F.col("path").alias("prefix")), "prefix", "left_semi").select("id")
    return below.union(records.join(nodes, "id", "left_semi").select("id")).distinct()


def leaf_branching(records: DataFrame) -> int | Column:
    """The leaf-weighted lower median of the child counts of modules that hold leaves (counts capped at 4095)."""
    kids = child_counts(records)
    weight = kids.filter("leaf_children > 0").groupBy(F.least("children", F.lit(4095)).alias("children")).agg(F.sum("leaf_children").alias("w"))
    run = F.sum("w").over(Window.orderBy("children"))  # at most 4095 rows
    total = F.sum("w").over(Window.partitionBy())
    return weight.withColumn("acc", run).withColumn("total", total).filter("2 * acc >= total").agg(F.coalesce(F.min("children"), F.lit(1)).alias("leaf_branching"))


def child_counts(records: DataFrame) -> DataFrame:
    """(path, children, leaf_children) of every module."""
    leaves = enclosing_modules(records).groupBy(F.col("module").alias("path")).agg(F.count("*").alias("leaf_children"))
    subs = closure(records).filter("depth > 0").select("prefix", "depth").distinct().groupBy(F.slice("prefix", 1, F.col("depth") - 1).alias("path")).agg(F.count("*").alias("sub"))
    return leaves.join(subs, "path", "full").select("path", (F.coalesce("leaf_children", F.lit(0)) + F.coalesce("sub", F.lit(0))).alias("children"), F.coalesce("leaf_children", F.lit(0)).alias("leaf_children"))


def sibling_links(tree: DataFrame) -> DataFrame:
    """(module, a, b, weight): a chain through the children of each module of a tree (node, parent), by number."""
    kids = tree.filter("parent is not null").select("parent", "node")
    after = F.lead("node").over(Window.partitionBy("parent").orderBy("node"))
    return kids.withColumn("b", after).filter("b is not null").select(F.col("parent").alias("module"), F.col("node").alias("a"), "b", F.lit(1.0).alias("weight"))


def module_arcs(records: DataFrame) -> DataFrame:
    """(path, start, width): each module's share of the hue circle; siblings in branch order split their parent's.

    Arcs are a fold over the path's (ordinal, siblings) pairs, which a join per depth collects.
    """
    modules = closure(records).filter("depth > 0").select(F.col("prefix").alias("path"), "depth").distinct()
    up = F.slice("path", 1, F.col("depth") - 1)
    own = modules.withColumn("up", up).withColumn("ordinal", F.row_number().over(Window.partitionBy("up").orderBy(F.element_at("path", -1))) - 1).withColumn("siblings", F.count("*").over(Window.partitionBy("up")))
    chain = modules.select("path", "depth", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("k")).withColumn("at", F.slice("path", 1, F.col("k")))
    steps = chain.join(own.select(F.col("path").alias("at"), "ordinal", "siblings"), "at").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "ordinal", "siblings"))).alias("s"))
    arc = F.aggregate(
        "s", F.struct(F.lit(0.0).alias("start"), F.lit(360.0).alias("width")),
        lambda a, s: F.struct((a["start"] + a["width"] / s["siblings"] * s["ordinal"]).alias("start"), (a["width"] / s["siblings"]).alias("width")),
    )
    return steps.withColumn("arc", arc).select("path", "arc.start", "arc.width")


def module_hues(records: DataFrame, rotate: float = 20.0) -> DataFrame:
    """(path, hue): the centre of each module's arc."""
    return module_arcs(records).select("path", ((F.col("start") + F.col("width") / 2 + rotate) % 360).alias("hue"))


def path_key(path: str | Column, level: int) -> Column:
    """The key of a path's module at a level, as text; "root" for an empty path."""
    path = F.col(path) if isinstance(path, str) else path
    depth = F.greatest(F.lit(1), F.least(F.lit(level), F.size(path) - 1))
    return F.when(F.size(path) == 0, "root").otherwise(F.array_join(F.slice(path, 1, depth), ":"))


GOLDEN = math.pi * (3 - math.sqrt(5))
