"""Hit tests on drawables and clipped layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import distance_to_path, point_in_ring


def pick_drawable(drawables: DataFrame, px: float, py: float, tolerance: float = 0.0) -> DataFrame:
    """(ord, id): the topmost visible drawable under a point.

    Drawables are (ord, id, kind, points, half_width, radius, hidden): kind "fill" is a ring, "stroke" a path,
    "circle" its first point and radius. A box test on the points comes first.
    """
    x, y = F.lit(float(px)), F.lit(float(py))
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    pad = F.greatest(F.coalesce("half_width", F.lit(0.0)), F.coalesce("radius", F.lit(0.0))) + tolerance
    near = (F.array_min(xs) - pad <= x) & (F.array_max(xs) + pad >= x) & (F.array_min(ys) - pad <= y) & (F.array_max(ys) + pad >= y)
    first = F.col("points")[0]
    hit = (
        F.when(F.col("kind") == "fill", point_in_ring(x, y, F.col("points")))
        .when(F.col("kind") == "stroke", distance_to_path(x, y, F.col("points")) <= F.col("half_width") + tolerance)
        .otherwise(F.hypot(first[0] - x, first[1] - y) <= F.col("radius") + tolerance)
    )
    return drawables.filter(~F.col("hidden")).filter(near).filter(hit).agg(F.max("ord").alias("ord"), F.max_by("id", "ord").alias("id"))


def pick_layers(layers: list[tuple[str, DataFrame, str | None]], px: float, py: float) -> DataFrame:
    """(layer, id): over layers (name, drawables, clip layer) from bottom to top the topmost hit; a clipped layer is
    hit only where its clip layer is."""
    hits = None
    for no, (name, rows, _) in enumerate(layers):
        hit = pick_drawable(rows, px, py).filter("id is not null").select(F.lit(no).alias("no"), F.lit(name).alias("layer"), F.col("id").cast("string").alias("id"))
        hits = hit if hits is None else hits.unionByName(hit)
    found = hits.select("layer").withColumnRenamed("layer", "clip")
    clips = hits.sparkSession.createDataFrame([(n, c) for n, _, c in layers], "layer string, clip string")
    ok = hits.join(clips, "layer").join(found.withColumn("on", F.lit(True)), "clip", "left").filter("clip is null or on")
    return ok.orderBy(F.desc("no")).limit(1).select("layer", "id")
