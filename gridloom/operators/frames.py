"""Streams of results for a view: layout frames, nested layout level by level, level-of-detail steps, labels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import morton as M
from gridloom.operators.declutter import cull_labels
from gridloom.operators.spatial import morton_cells
from gridloom.operators.view import View


def lod_frames(frames: Iterable[tuple[int, DataFrame]], box: tuple[float, float, float] | None = None, bucket: int = 8) -> Iterator[tuple[int, DataFrame]]:
    """(frame, cells) for each frame of positions (id, x, y): the Morton tree anew; the root box is kept while the
    points stay inside, and a frame without a move is skipped."""
    last = None
    for number, points in frames:
        mark = points.agg(F.sum(F.xxhash64("id", "x", "y").cast("decimal(38,0)")).alias("m")).first()["m"]
        if mark == last:
            continue
        last = mark
        now = M.root_box(points)
        inside = box is not None and box[0] <= now[0] and box[1] <= now[1] and now[0] + now[2] <= box[0] + box[2] and now[1] + now[2] <= box[1] + box[2]
        box = box if inside else now
        yield number, morton_cells(M.quantized(points, box), bucket)


def nested_frames(discs: DataFrame, tree: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(depth, discs) of a nested layout from the root down; ``tree`` is (node, parent)."""
    level, depth = tree.filter("parent is null").select("node"), 0
    while not level.isEmpty():
        yield depth, discs.join(level, "node", "left_semi")
        level = tree.join(level.select(F.col("node").alias("parent")), "parent", "left_semi").select("node")
        depth += 1


def place_labels(anchors: DataFrame, view: View, char_width: float = 6.0, height: float = 12.0, padding: float = 2.0) -> DataFrame:
    """(id): labels of anchors (id, x, y, text, priority) that fit on a view's screen, priority first."""
    sized = anchors.filter("text is not null").select("id", (F.col("x") * view.k + view.x).alias("x"), (F.col("y") * view.k + view.y).alias("y"), (F.length("text") * char_width).alias("width"), F.lit(height).alias("height"), "priority")
    return cull_labels(sized, view.width, view.height, padding)


def smoothstep(x: Column) -> Column:
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(x * x * (3 - 2 * x))


def fade(footprint: Column, expand_px: float, band: float) -> Column:
    """Alpha of a collapsed module near its expansion: 1 below the band around ``expand_px``, 0 above."""
    low, high = expand_px * (1 - band), expand_px * (1 + band)
    return smoothstep((high - footprint) / (high - low))
