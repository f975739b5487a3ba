"""Module springs: pulls between modules, spread over their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.hierarchy import closure


def module_springs(links: DataFrame) -> DataFrame:
    """(src, dst, weight): module links (src, dst, flow) between different modules, weighed so that they average 1."""
    rows = links.filter("src <> dst").groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
    unit = rows.agg(F.coalesce(F.count("*") / F.sum("flow"), F.lit(0.0))).first()[0] or 0.0
    return rows.select("src", "dst", (F.col("flow") * F.lit(float(unit))).alias("weight"))


def module_masses(records: DataFrame, masses: DataFrame | None = None) -> DataFrame:
    """(path, mass): the sum of the members' masses (id, mass), 1 each by default."""
    at = closure(records)
    at = at.join(masses, "id") if masses is not None else at.withColumn("mass", F.lit(1.0))
    return at.groupBy(F.col("prefix").alias("path")).agg(F.sum("mass").alias("mass"))


def spring_gain(records: DataFrame, springs: DataFrame) -> DataFrame:
    """(id, gain): for each node the weights of the springs at the modules above it over these modules' masses."""
    ends = springs.select(F.explode(F.array("src", "dst")).alias("path"), "weight").groupBy("path").agg(F.sum("weight").alias("w"))
    per = ends.join(module_masses(records), "path").select(F.col("path").alias("prefix"), (F.col("w") / F.col("mass")).alias("g"))
    gains = closure(records).join(per, "prefix").groupBy("id").agg(F.sum("g").alias("gain"))
    return records.select("id").join(gains, "id", "left").fillna(0.0, ["gain"])


def module_forces(records: DataFrame, points: DataFrame, springs: DataFrame, attraction: float = 0.05) -> DataFrame:
    """(id, ax, ay): accelerations of nodes: attraction * weight * (difference of centroids) at each end, over the
    module's mass, summed over the modules above a node."""
    at = closure(records).join(points.select("id", "x", "y"), "id")
    c = at.groupBy(F.col("prefix").alias("path")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("mass"))
    end = lambda p, k: c.select(F.col("path").alias(p), F.col("cx").alias(k + "x"), F.col("cy").alias(k + "y"))
    s = springs.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    fx, fy = attraction * F.col("weight") * (F.col("bx") - F.col("ax")), attraction * F.col("weight") * (F.col("by") - F.col("ay"))
    pulls = s.select(F.explode(F.array(F.struct(F.col("src").alias("path"), fx.alias("fx"), fy.alias("fy")), F.struct(F.col("dst").alias("path"), (-fx).alias("fx"), (-fy).alias("fy")))).alias("p")).groupBy("p.path").agg(F.sum("p.fx").alias("fx"), F.sum("p.fy").alias("fy"))
    per = pulls.join(c, "path").select(F.col("path").alias("prefix"), (F.col("fx") / F.col("mass")).alias("ax"), (F.col("fy") / F.col("mass")).alias("ay"))
    sums = closure(records).join(per, "prefix").groupBy("id").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))
    return records.select("id").join(sums, "id", "left").fillna(0.0, ["ax", "ay"])


def warm_start(records: DataFrame, points: DataFrame) -> DataFrame:
    """(path, cx, cy, spread): centroid and root mean square distance of each module's members, NaN positions out."""
    ok = points.filter(~F.isnan("x") & ~F.isnan("y"))
    g = closure(records).join(ok.select("id", "x", "y"), "id").groupBy(F.col("prefix").alias("path"))
    m = g.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("q"))
    return m.select("path", "cx", "cy", F.sqrt(F.greatest(F.col("q") - F.col("cx") * F.col("cx") - F.col("cy") * F.col("cy"), F.lit(0.0))).alias("spread"))
