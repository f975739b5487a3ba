"""Morton trees over points, cells of earlier trees, cover of leaves by frontier cells, links between cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import morton as M

MAX_DEPTH, BUCKET = 16, 8


def morton_cells(coded: DataFrame, bucket: int = BUCKET, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(level, code, n, first_code, last_code): the cells of the compressed quadtree of points with a ``code``.

    Every point stands in its 17 prefixes; equal prefixes are counted on the map side, so the shuffle carries
    cells, not points. A prefix is a cell if it is the root's or its parent prefix holds over ``bucket`` points that
    first differ right there; its own level is as deep as its points agree.
    """
    tiles = coded.select("code", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("l")).withColumn("prefix", M.prefix(F.col("code"), F.col("l")))
    groups = tiles.groupBy("l", "prefix").agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    up = groups.select((F.col("l") + 1).alias("l"), F.col("prefix").alias("up"), F.col("n").alias("up_n"), M.common_level(F.col("lo"), F.col("hi")).alias("up_level"))
    cells = groups.withColumn("up", M.prefix(F.col("prefix"), F.col("l") - 1)).join(up, ["l", "up"], "left")
    split = (F.col("up_n") > bucket) & (F.col("up_level") == F.col("l") - 1) & (F.col("l") - 1 < max_depth)
    kept = cells.filter((F.col("l") == 0) | split).filter("l > 0 or n > 1")
    level = M.common_level(F.col("lo"), F.col("hi"))
    return kept.select(level.alias("level"), M.prefix(F.col("lo"), level).alias("code"), "n", F.col("lo").alias("first_code"), F.col("hi").alias("last_code"))


def find_cells(asked: DataFrame, cells: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(level, code, found_level, found_code): for each asked cell the deepest cell that covers or equals it."""
    a = asked.select("level", "code", F.explode(F.sequence(F.lit(0), "level")).alias("found_level")).withColumn("found_code", M.prefix(F.col("code"), F.col("found_level")))
    hit = a.join(cells.select(F.col("level").alias("found_level"), F.col("code").alias("found_code")).distinct(), ["found_level", "found_code"])
    return hit.groupBy("level", "code").agg(F.max("found_level").alias("found_level"), F.max_by("found_code", "found_level").alias("found_code"))


def leaf_ranks(coded: DataFrame) -> DataFrame:
    """Points numbered along the Morton curve, ties by id."""
    from gridloom.plans.storage import dense_index

    return dense_index(coded, ["code", "id"], "rank")


def covers(coded: DataFrame, frontier: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, cell_level, cell_code): the frontier cell (level, code) that covers each point.

    Frontier cells don't overlap, so each of a point's prefixes is one equality lookup; there is no range join.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(max_depth)))
    at = coded.select("id", "code", levels.alias("level")).withColumn("prefix", M.prefix(F.col("code"), F.col("level")))
    return at.join(frontier.select("level", F.col("code").alias("prefix")), ["level", "prefix"]).select("id", F.col("level").alias("cell_level"), F.col("prefix").alias("cell_code"))


def kept_rows(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(cell, partner, out_flow, in_flow): flow between covering cells both ways, own pairs dropped; cover is (id, cell)."""
    a = cover.select(F.col("id").alias("source"), F.col("cell").alias("cs"))
    b = cover.select(F.col("id").alias("target"), F.col("cell").alias("ct"))
    pairs = edges.join(a, "source").join(b, "target").filter("cs <> ct").groupBy("cs", "ct").agg(F.sum("weight").alias("w"))
    both = pairs.select(F.col("cs").alias("cell"), F.col("ct").alias("partner"), F.col("w").alias("o"), F.lit(0).cast("long").alias("i")).unionByName(pairs.select(F.col("ct").alias("cell"), F.col("cs").alias("partner"), F.lit(0).cast("long").alias("o"), F.col("w").alias("i")))
    return both.groupBy("cell", "partner").agg(F.sum("o").alias("out_flow"), F.sum("i").alias("in_flow"))


def lazy_super_edges(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(a, b, flow_ab, flow_ba): each pair of cells once, with the flow of both directions."""
    r = kept_rows(edges, cover)
    return r.filter("cell < partner").select(F.col("cell").alias("a"), F.col("partner").alias("b"), F.col("out_flow").alias("flow_ab"), F.col("in_flow").alias("flow_ba"))


def layout_box(points: DataFrame) -> DataFrame:
    """(x0, x1, y0, y1) over finite points."""
    ok = ~F.isnan("x") & ~F.isnan("y")
    return points.filter(ok).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def trimmed_range(points: DataFrame, column: str, bins: int = 256, share: float = 0.005, most: int = 64) -> DataFrame:
    """(lo, hi): the range of a column without the outermost bins that hold at most min(most, share * n) points a side."""
    v = points.filter(~F.isnan(column)).select(F.col(column).alias("v"))
    lo, hi, n = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n or hi == lo:
        return v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    allow, width = min(most, int(share * n)), (hi - lo) / bins
    h = v.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
    w = Window.orderBy("bin")  # bins rows at most
    h = h.withColumn("below", F.sum("c").over(w)).withColumn("above", F.lit(n) - F.col("below") + F.col("c"))
    return h.filter(f"below > {allow} and above > {allow}").agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
