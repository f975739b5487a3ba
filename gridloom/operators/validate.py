"""Checks that run before an update takes effect; each raises and names what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.hierarchy import closure


def has_layout(points: DataFrame) -> bool:
    """Whether two finite positions differ."""
    ok = points.filter(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    r = ok.agg((F.min("x") < F.max("x")).alias("a"), (F.min("y") < F.max("y")).alias("b")).first()
    return bool(r["a"] or r["b"])


def check_records(nodes: DataFrame, records: DataFrame) -> None:
    """Every node has one record with a path that isn't empty, and every record a node."""
    per = records.groupBy("id").agg(F.count("*").alias("n"), F.min(F.size("path")).alias("least"))
    j = nodes.select("id", F.lit(True).alias("known")).join(per, "id", "full")
    why = F.when(F.col("known").isNull(), "is no node of the graph").when(F.col("n").isNull(), "has no module record").when(F.col("n") > 1, "has several module records").when(F.col("least") < 1, "has an empty path")
    bad = j.select("id", why.alias("why")).filter("why is not null").orderBy("id").limit(1).collect()
    if bad:
        raise ValueError(f"node {bad[0]['id']} {bad[0]['why']}")


def check_values(nodes: DataFrame, values: DataFrame, name: str = "flow") -> None:
    """One value for each node, no more."""
    missing = nodes.join(values, "id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"node {missing[0]['id']} has no {name}")
    if nodes.count() != values.count():
        raise ValueError(f"{name} must have one row per node")


def check_links(links: DataFrame, records: DataFrame) -> None:
    """Both ends (src, dst) of module links are modules or nodes."""
    known = closure(records).select(F.col("prefix").alias("path")).union(records.select("path")).distinct()
    ends = links.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    bad = ends.join(known, "path", "left_anti").select(F.array_join("path", ":").alias("p")).orderBy("p").limit(1).collect()
    if bad:
        raise ValueError(f"no module or node at path {bad[0]['p']}")


def draws_links(width: float | str | None) -> bool:
    """Whether a constant link style draws anything, so that plans can leave the links out."""
    return not (width is None or width == "none" or width == 0)
