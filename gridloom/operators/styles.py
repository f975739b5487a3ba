"""Style columns: overrides, dimming, metrics, borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.color import byte


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """``rows`` (id, fill, alpha) under the last override (id, fill, opacity, version) of each id; a null field keeps
    the base, opacity multiplies alpha."""
    last = overrides.groupBy("id").agg(F.max_by("fill", F.when(F.col("fill").isNotNull(), F.col("version"))).alias("ofill"), F.max_by("opacity", F.when(F.col("opacity").isNotNull(), F.col("version"))).alias("oopacity"))
    alpha = byte(F.col("alpha") * F.least(F.greatest(F.coalesce("oopacity", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))
    return rows.join(last, "id", "left").select("id", F.coalesce("ofill", "fill").alias("fill"), alpha.alias("alpha"))


def dim_others(rows: DataFrame, selected: DataFrame, opacity: float) -> DataFrame:
    """``rows`` (id, alpha): alpha of those not in ``selected`` (id) times the opacity."""
    kept = selected.select("id").distinct().withColumn("kept", F.lit(True))
    return rows.join(kept, "id", "left").select("id", F.when(F.col("kept"), F.col("alpha")).otherwise(byte(F.col("alpha") * opacity)).alias("alpha"))


def metric(rows: DataFrame, by: str | Column) -> Column:
    """degree, strength, flow or any column expression; a flow that the table doesn't have raises."""
    if isinstance(by, Column):
        return by
    if by not in rows.columns:
        raise ValueError(f"the graph has no {by}")
    return F.col(by)


def share_border(r: Column, e: Column, f: Column) -> Column:
    """Width of a border whose ring has e / f of the disc's area; null without a positive f, or without e (null or NaN)."""
    return F.when((f > 0) & ~F.isnan(f) & e.isNotNull() & ~F.isnan(e), r - r * F.sqrt(1 - F.least(F.greatest(e / f, F.lit(0.0)), F.lit(1.0))))
