"""Connected components of an edge table by alternating large and small stars.

Every round is one aggregation and one join per star, written to the shared folder; a hub's edges are never
gathered in one task. The number of rounds grows with the logarithm of the largest component, squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_scratch, gathered, scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them. Edges have a > b."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, edges.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) touches; root is its component's smallest node."""
    edges = scratch(gathered(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), "edges")
    state = _state(edges)
    while state[0]:
        stars = scratch(gathered(_small(_large(edges))), "edges")
        drop_scratch(edges)
        edges, before = stars, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
