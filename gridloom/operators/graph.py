"""Graph metrics and reshapes over (edge_id, source, target, weight) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.storage import dense_index


def degree_strength(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and strength of every node of ``nodes`` (id); a self-link counts once, an isolated node 0.

    Ends are unpivoted in the projection, so that counts are combined before the one shuffle.
    """
    ends = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
    sums = edges.select(F.explode(ends).alias("id"), "weight").groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return nodes.join(sums, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0)).alias("strength"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, pos, neighbor, weight): the symmetric neighbour rows in edge order; a self-link is in twice."""
    both = edges.select("edge_id", "weight", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("id"), F.col("target").alias("neighbor")), F.struct(F.lit(1).alias("side"), F.col("target").alias("id"), F.col("source").alias("neighbor")))).alias("e"))
    pos = F.row_number().over(Window.partitionBy("id").orderBy("edge_id", "side")) - 1
    return both.select("edge_id", "weight", "e.*").withColumn("pos", pos.cast("long")).select("id", "pos", "neighbor", "weight")


def reciprocal_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, reciprocal): the last opposite link of each link, else -1."""
    last = edges.groupBy(F.col("source").alias("t"), F.col("target").alias("s")).agg(F.max("edge_id").alias("back"))
    return edges.join(last, (edges.source == last.s) & (edges.target == last.t), "left").select("edge_id", F.coalesce("back", F.lit(-1)).alias("reciprocal"))


def self_loops(edges: DataFrame) -> DataFrame:
    """(node, first_edge, weight): one loop per node, weights summed."""
    return edges.filter("source = target").groupBy(F.col("source").alias("node")).agg(F.min("edge_id").alias("first_edge"), F.sum("weight").alias("weight"))


def loop_of_edge(edges: DataFrame) -> DataFrame:
    """(edge_id, loop): the ordinal of the loop that an edge opens, else -1."""
    opened = self_loops(edges).select(F.col("first_edge").alias("edge_id"), "node")
    ordinal = dense_index(opened, ["edge_id"], "loop")
    return edges.join(ordinal, "edge_id", "left").select("edge_id", F.coalesce("loop", F.lit(-1)).cast("long").alias("loop"))


def merge_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(source, target, weight, first_edge): links summed per ordered pair of groups; groups is (id, grp)."""
    a = groups.select(F.col("id").alias("source"), F.col("grp").alias("gs"))
    b = groups.select(F.col("id").alias("target"), F.col("grp").alias("gt"))
    return edges.join(a, "source").join(b, "target").groupBy(F.col("gs").alias("source"), F.col("gt").alias("target")).agg(F.sum("weight").alias("weight"), F.min("edge_id").alias("first_edge"))


def group_members(groups: DataFrame) -> DataFrame:
    """(grp, pos, id): members in id order."""
    return groups.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("id")) - 1).cast("long").alias("pos"), "id")


def group_flow(values: DataFrame, groups: DataFrame, value: str = "flow") -> DataFrame:
    return values.join(groups, "id").groupBy("grp").agg(F.sum(value).alias(value))


def leaf_links(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``kept`` (id), self-links excluded."""
    ends = lambda c: kept.select(F.col("id").alias(c))
    return edges.filter("source <> target").join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")


def spring_unit(edges: DataFrame) -> DataFrame:
    """(unit): links per weight without self-links, 0 if there is no weight."""
    s = edges.filter("source <> target").agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    return s.select(F.when(F.col("w") > 0, F.col("n") / F.col("w")).otherwise(F.lit(0.0)).alias("unit"))


def coarse_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(source, target, weight): undirected links between groups, smaller id first, inner links dropped."""
    merged = merge_groups(edges, groups)
    return merged.filter("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight")).select(F.col("a").alias("source"), F.col("b").alias("target"), "weight")


def instance_runs(ids: DataFrame) -> DataFrame:
    """(start, stop): the runs [start, stop) that sorted distinct ids form (gaps and islands, by neighbours).

    A run starts at an id whose predecessor is missing: two anti-joins, no global window.
    """
    one = ids.select("id").distinct()
    starts = one.join(one.select((F.col("id") + 1).alias("id")), "id", "left_anti").select(F.col("id").alias("start"))
    ends = one.join(one.select((F.col("id") - 1).alias("id")), "id", "left_anti").select((F.col("id") + 1).alias("stop"))
    return dense_index(starts, ["start"], "n").join(dense_index(ends, ["stop"], "n"), "n").select("start", "stop")
