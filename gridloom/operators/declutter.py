"""Greedy thinning.

Greedy thinning by priority keeps the lexicographically first independent set of the conflict graph. ``thinned`` takes
rows in blocks of ranks, each twice as long as the one before: tiles of the screen drop in parallel what earlier blocks'
kept rows hide, and one pass in order decides the rest. Rows are only compared with kept ones, which lie apart, so that
no table of conflicts is made: in a crowd it grows with the square of the rows. ``independent_set`` is the form for given
conflicts, as rounds of local winners.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.view import View
from gridloom.plans.storage import drop_stored, stored


def independent_set(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id): rows (id, rank) kept greedily by ascending rank; conflicts is (a, b), each pair both ways.

    Ranks are distinct. Ends after as many rounds as the longest chain of decisions, each cutting the conflicts.
    """
    ranks = rows.select("id", "rank")
    open_pairs = stored(conflicts.join(ranks.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ranks.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b"), "conflicts")
    lost = None
    while True:
        least = open_pairs.groupBy("a", "ra").agg(F.min("rb").alias("m"))
        kept = least.filter("ra < m").select(F.col("a").alias("id"))
        dropped = stored(open_pairs.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        if dropped.isEmpty():
            break
        lost = dropped if lost is None else lost.union(dropped)
        gone = dropped.select(F.col("id").alias("a"))
        left = stored(open_pairs.join(gone, "a", "left_anti").join(dropped.select(F.col("id").alias("b")), "b", "left_anti"), "conflicts")
        drop_stored(open_pairs)
        open_pairs = left
    return ranks.select("id") if lost is None else ranks.select("id").join(lost, "id", "left_anti")


#: Rows of the first block, and rows that a tile is meant to have. A tile's sides are at least twice the largest reach.
BLOCK_ROWS = 8192


class _Kept:
    """Kept rows by cells as large as the largest reach."""

    def __init__(self, size: float, hit: Callable[[tuple, tuple], bool]):
        self.size, self.hit, self.cells = size, hit, {}

    def _cell(self, row: tuple) -> tuple[int, int]:
        return math.floor(row[0] / self.size), math.floor(row[1] / self.size)

    def add(self, row: tuple) -> None:
        self.cells.setdefault(self._cell(row), []).append(row)

    def hides(self, row: tuple) -> bool:
        cx, cy = self._cell(row)
        return any(self.hit(row, o) for a in (0, -1, 1) for b in (0, -1, 1) for o in self.cells.get((cx + a, cy + b), ()))


def thinned(rows: DataFrame, size: float, hit: Callable[[tuple, tuple], bool], columns: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """(id): rows (id, rank, x, y and others) kept greedily by rank, which counts from 0. ``hit`` tells of two tuples of
    ``columns``, x and y first, whether they conflict, which no rows ``size`` or more apart in x or y do."""
    size = size * (1 + 1e-9)
    n, x0, x1, y0, y1 = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    rows = rows.select("id", "rank", *columns)
    if not n:
        return rows.select("id")
    names, schema = rows.columns, rows.schema
    side = max(2 * size, math.sqrt(max(x1 - x0, size) * max(y1 - y0, size) * block / n))
    tiles = math.ceil((x1 - x0 + size) / side) * math.ceil((y1 - y0 + size) / side)

    def tuples(pdf: pd.DataFrame):
        return zip(*(pdf[c].tolist() for c in columns))

    def uncovered(key: tuple[int, int], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kept = _Kept(size, hit)
        for row in tuples(right):
            kept.add(row)
        return left.loc[[not kept.hides(row) for row in tuples(left)], names]

    def walk(batches):
        kept = _Kept(size, hit)
        for pdf in batches:
            stay = []
            for row in tuples(pdf):
                stay.append(not kept.hides(row))
                if stay[-1]:
                    kept.add(row)
            yield pdf.loc[stay]

    def tile(c: str, c0: float, by: float = 0.0) -> Column:
        return F.floor((F.col(c) - c0 + by) / side)

    around = lambda c, c0: F.explode(F.sequence(tile(c, c0, -size), tile(c, c0, size)))
    done, start = None, 0
    while start < n:
        part = rows.filter(F.col("rank").between(start, start + block - 1))
        if done is not None:
            near = done.select("*", around("x", x0).alias("tx")).select("*", around("y", y0).alias("ty"))
            own = part.select("*", tile("x", x0).alias("tx"), tile("y", y0).alias("ty"))
            deal = lambda d: d.repartition(min(tiles, 1024), "tx", "ty").groupBy("tx", "ty")
            part = deal(own).cogroup(deal(near)).applyInPandas(uncovered, schema)
        chosen = stored(part.repartition(1).sortWithinPartitions("rank").mapInPandas(walk, schema), "thinned")
        done = chosen if done is None else done.unionByName(chosen)
        start, block = start + block, 2 * block
    return done.select("id")


def _grid(rows: DataFrame, size: float) -> DataFrame:
    return rows.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})


def near_pairs(rows: DataFrame, size: float, conflict: Column, columns: list[str]) -> DataFrame:
    """(a, b), both ways: rows in neighbouring cells of a grid of ``size`` that meet a condition over their columns
    and those of the other row, prefixed with o_."""
    g = _grid(rows, size)
    around = F.expr("explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(gx + i as gx, gy + j as gy)))))")
    other = g.select(*[F.col(c).alias("o_" + c) for c in ("id", *columns)], around.alias("g")).select("*", "g.gx", "g.gy").drop("g")
    return g.join(other, ["gx", "gy"]).filter((F.col("id") != F.col("o_id")) & conflict).select(F.col("id").alias("a"), F.col("o_id").alias("b"))


def discs_meet(spacing: float) -> Callable[[tuple, tuple], bool]:
    """Whether two discs (x, y, r, ...) lie within spacing * (ri + rj) of each other."""

    def meet(a: tuple, b: tuple) -> bool:
        dx, dy, limit = a[0] - b[0], a[1] - b[1], spacing * (a[2] + b[2])
        return dx * dx + dy * dy < limit * limit

    return meet


def declutter(points: DataFrame, view: View, spacing: float = 1.0, order: Column | None = None) -> DataFrame:
    """(id): points kept on a view's screen: by ``order`` (ascending, then id), one is dropped if it lies within
    spacing * (ri + rj) of a kept one, in pixels. Rows off the screen stay and hide nothing; negative radii are 0."""
    from gridloom.plans.storage import dense_index

    s = points.select("id", (F.col("x") * view.k + view.x).alias("x"), (F.col("y") * view.k + view.y).alias("y"), F.greatest("radius", F.lit(0.0)).alias("r"), *([order.alias("ord")] if order is not None else []))
    on = F.col("x").between(0, view.width) & F.col("y").between(0, view.height) & ~F.isnan("x") & ~F.isnan("y")
    shown = stored(dense_index(s.filter(on), (["ord"] if order is not None else []) + ["id"], "rank"), "on-screen")
    off = s.filter(~F.coalesce(on, F.lit(False))).select("id")
    reach = shown.agg(F.max("r")).first()[0]
    if not reach:
        return s.select("id")
    return thinned(shown, 2 * spacing * reach, discs_meet(spacing), ["x", "y", "r"]).union(off)


def cull_labels(labels: DataFrame, width: float, height: float, padding: float = 0.0) -> DataFrame:
    """(id): label boxes (id, x, y, width, height, priority, maybe rotation; x, y the centre) kept by priority, then id.

    Boxes that miss the viewport are dropped first; boxes that only touch don't collide. Rotated boxes (radians) are
    compared along the axes of both; their bounds come first.
    """
    from gridloom.functions.labels import overlap
    from gridloom.plans.storage import dense_index

    w, h = F.col("width") / 2 + padding, F.col("height") / 2 + padding
    turned = "rotation" in labels.columns
    a = F.coalesce("rotation", F.lit(0.0)) if turned else F.lit(0.0)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    bound = (w * c + h * s, w * s + h * c) if turned else (w, h)
    boxes = labels.select("id", "x", "y", bound[0].alias("hw"), bound[1].alias("hh"), w.alias("bw"), h.alias("bh"), a.alias("a"), F.col("priority"))
    seen = boxes.filter((F.col("x") + F.col("hw") > 0) & (F.col("x") - F.col("hw") < width) & (F.col("y") + F.col("hh") > 0) & (F.col("y") - F.col("hh") < height))
    shown = stored(dense_index(seen, [F.col("priority").desc(), F.col("id")], "rank"), "labels")
    reach = shown.agg(F.max(F.greatest("hw", "hh"))).first()[0]
    if not reach:
        return shown.select("id")
    if not turned:
        return thinned(shown, 2 * reach, lambda p, q: abs(p[0] - q[0]) < p[2] + q[2] and abs(p[1] - q[1]) < p[3] + q[3], ["x", "y", "hw", "hh"])
    hit = (F.abs(F.col("x") - F.col("o_x")) < F.col("hw") + F.col("o_hw")) & (F.abs(F.col("y") - F.col("o_y")) < F.col("hh") + F.col("o_hh"))
    hit = hit & overlap(*map(F.col, ("x", "y", "bw", "bh", "a", "o_x", "o_y", "o_bw", "o_bh", "o_a")))
    return independent_set(shown, near_pairs(shown, 2 * reach, hit, ["x", "y", "hw", "hh", "bw", "bh", "a"]))


def winners(points: DataFrame, kept: DataFrame, view: View, spacing: float = 1.0) -> DataFrame:
    """(id, winner): for each dropped point the kept one nearest to it among those that hide it."""
    s = points.select("id", (F.col("x") * view.k + view.x).alias("x"), (F.col("y") * view.k + view.y).alias("y"), F.greatest("radius", F.lit(0.0)).alias("r")).join(kept.withColumn("kept", F.lit(True)), "id", "left")
    s = stored(s, "thinned-points")
    reach = s.agg(F.max("r")).first()[0] or 1.0
    g = _grid(s, 2 * spacing * reach)
    around = F.expr("explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(gx + i as gx, gy + j as gy)))))")
    lost = g.filter("kept is null").select("id", "x", "y", "r", around.alias("g")).select("id", "x", "y", "r", "g.gx", "g.gy")
    other = g.filter("kept").select(F.col("id").alias("o_id"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), F.col("r").alias("o_r"), "gx", "gy")
    dx, dy = F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")
    limit, square = spacing * (F.col("r") + F.col("o_r")), dx * dx + dy * dy
    d = lost.join(other, ["gx", "gy"]).filter(square < limit * limit).select("id", F.sqrt(square).alias("d"), F.col("o_id").alias("b"))
    return d.groupBy("id").agg(F.min_by("b", F.struct("d", "b")).alias("winner"))
