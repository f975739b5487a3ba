"""Iterative graph algorithms: random-walk flow, coarsening, force layout."""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import merge_groups
from gridloom.plans.storage import drop_stored, stored


def random_walk_flow(nodes: DataFrame, edges: DataFrame, teleport: float = 0.15, tolerance: float = 1e-12, steps: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(node_flow (id, flow), link_flow (edge_id, flow)): PageRank with teleports and dangling mass by in-strength.

    Parallel links are summed once, so that a step is a join on the source and an aggregation by target over
    distinct pairs. Each step's vector is written, which cuts lineage and lets the stop test read it.
    """
    pairs = stored(edges.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("w")), "walk-links")
    out = pairs.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("out"))
    into = pairs.groupBy(F.col("target").alias("id")).agg(F.sum("w").alias("into"))
    n = nodes.count()
    total = pairs.agg(F.sum("w")).first()[0] or 0.0
    base = nodes.select("id").join(out, "id", "left").join(into, "id", "left")
    v = F.coalesce(F.col("into"), F.lit(0.0)) / total if total else F.lit(1.0 / max(n, 1))
    base = stored(base.select("id", F.coalesce("out", F.lit(0.0)).alias("out"), v.alias("v")), "walk-nodes")
    shares = stored(pairs.join(base.select(F.col("id").alias("source"), "out"), "source").select("source", "target", (F.col("w") / F.col("out")).alias("share")), "walk-shares")
    p, old = base.select("id", F.lit(1.0 / max(n, 1)).alias("p")), None
    lost = base.filter("out = 0").count() / max(n, 1)  # the mass of nodes without a way out
    for step in range(steps if total else 0):
        mass = p.join(base, "id")
        moved = shares.join(p, shares.source == p.id).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("moved"))
        new = mass.join(moved, "id", "left").select("id", "out", F.col("p").alias("was"), ((1 - teleport) * F.coalesce("moved", F.lit(0.0)) + (teleport + (1 - teleport) * lost) * F.col("v")).alias("p"))
        new = stored(new, "walk")
        change, lost = new.agg(F.sum(F.abs(F.col("p") - F.col("was"))), F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("p"))), F.lit(0.0))).first()
        p = new.select("id", "p")
        if old is not None:
            drop_stored(old)
        old = new
        if change < tolerance:
            break
    whole = p.agg(F.sum("p")).first()[0] or 1.0
    link = edges.join(p, edges.source == p.id).join(base.select(F.col("id").alias("bid"), "out"), F.col("source") == F.col("bid"))
    flow = F.when(F.col("out") > 0, F.col("p") * F.col("weight") / F.col("out")).otherwise(0.0)
    return p.select("id", (F.col("p") / whole).alias("flow")), link.select("edge_id", flow.alias("flow"))


def walk_steps(nodes: DataFrame, edges: DataFrame, steps: int, teleport: float = 0.15) -> DataFrame:
    """(id, flow) after a fixed number of steps."""
    return random_walk_flow(nodes, edges, teleport, tolerance=-1.0, steps=steps)[0]


def link_pairs(edges: DataFrame) -> DataFrame:
    """(source, target, weight, edge_id, top): one row per ordered pair of nodes with the sum of its links' weights, their
    first edge, and in top the negated weight and the id of its heaviest link, the first on ties.

    An edge_id may be of any type that has an order, such as a struct: it is compared, never counted with.
    """
    top = F.struct((-F.col("weight")).alias("w"), F.col("edge_id").alias("e"))
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.min("edge_id").alias("edge_id"), F.min(top).alias("top"))


def heavy_edge_matching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, grp): nodes in id order join their heaviest free neighbour (the first in edge order on ties), else the
    group of their heaviest taken neighbour, else stay alone; groups numbered in order of their first node.

    The result depends on the order of all nodes, so that it has no parallel form; the neighbours go through one
    Arrow kernel, one row per pair of nodes, sorted by Spark. The kernel holds the groups and one batch of rows.
    ``local_matching`` is the parallel form, with other groups.
    """
    return _matched(nodes, link_pairs(edges))


def _matched(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("nb")), F.struct(F.col("target").alias("id"), F.col("source").alias("nb"))))
    both = pairs.filter("source <> target").select("top", ends.alias("e")).groupBy("e.id", "e.nb").agg(F.min("top").alias("top"))
    table = nodes.select("id").join(both, "id", "left").repartition(1).sortWithinPartitions("id", "top").select("id", "nb")

    def match(batches):
        group: dict[int, int] = {}
        count, node, taken = 0, None, None
        for batch in batches:
            for v, nb in zip(batch["id"].to_pylist(), batch["nb"].to_pylist()):
                if v != node:
                    if node is not None and node not in group:
                        group[node], count = (count, count + 1) if taken is None else (group[taken], count)
                    node, taken = v, None
                if v in group or nb is None:
                    continue
                if nb not in group:
                    group[v] = group[nb] = count
                    count += 1
                elif taken is None:
                    taken = nb
        if node is not None and node not in group:
            group[node] = count if taken is None else group[taken]
        rows = iter(group.items())
        while part := list(itertools.islice(rows, 65536)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], ["id", "grp"])

    return table.mapInArrow(match, "id long, grp long")


def local_matching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, grp): the parallel form: of the open links those that are heaviest at both ends match, until none is."""
    e = stored(edges.filter("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("w")), "open-links")
    matched = None
    while True:
        key = F.struct("w", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        best = e.select(F.explode(F.array("a", "b")).alias("id"), key.alias("k")).groupBy("id").agg(F.max("k").alias("k"))
        won = e.withColumn("k", key).join(best.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(best.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b").filter("k = ka and k = kb")
        pairs = stored(won.select("a", "b"), "matched")
        if pairs.isEmpty():
            break
        matched = pairs if matched is None else matched.union(pairs)
        used = pairs.select(F.explode(F.array("a", "b")).alias("x"))
        e = stored(e.join(used, e.a == used.x, "left_anti").join(used, F.col("b") == used.x, "left_anti"), "open-links")
    if matched is None:
        return nodes.select("id", F.col("id").alias("grp"))
    return nodes.select("id").join(matched.select(F.col("b").alias("id"), F.col("a").alias("grp")), "id", "left").select("id", F.coalesce("grp", "id").alias("grp"))


def coarse_levels(nodes: DataFrame, edges: DataFrame, least: int = 8, most: int = 32) -> list[tuple[DataFrame, DataFrame]]:
    """[(projection (id, grp), coarse edges)] per level, until few nodes are left, or none merges."""
    out = []
    n = nodes.count()
    while n > least and len(out) < most:
        pairs = stored(link_pairs(edges), "link-pairs")
        groups = stored(_matched(nodes, pairs), "projection")
        up = merge_groups(pairs, groups).filter("source <> target")
        up = up.groupBy(F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t")).agg(F.sum("weight").alias("weight"), F.min("first_edge").alias("edge_id"))
        up = stored(up.select("edge_id", F.col("s").alias("source"), F.col("t").alias("target"), "weight"), "coarse")
        drop_stored(pairs)
        nodes = groups.select(F.col("grp").alias("id")).distinct()
        m = nodes.count()
        out.append((groups, up))
        if m >= n:
            break
        n, edges = m, up
    return out


def coarse_masses(levels: list[tuple[DataFrame, DataFrame]], nodes: DataFrame) -> list[DataFrame]:
    """(id, mass) per level: how many finest nodes each coarse node holds."""
    mass, out = nodes.select("id", F.lit(1).cast("long").alias("mass")), []
    for groups, _ in levels:
        mass = groups.join(mass, "id").groupBy(F.col("grp").alias("id")).agg(F.sum("mass").alias("mass"))
        out.append(mass)
    return out


SOFTENING, DAMPING, STEP_CAP = 1e-2, 0.9, 16.0


def equilibrium_spacing(repulsion: float = 200.0, centering: float = 0.2) -> float:
    return math.sqrt(math.pi * repulsion / centering)


def _push(dx, dy, m, repulsion: float):
    return [repulsion * m * d / (dx * dx + dy * dy + SOFTENING) for d in (dx, dy)]


def far_field(cells: DataFrame, levels: int, repulsion: float) -> DataFrame:
    """(gx, gy, fx, fy): the push on each finest cell of everything outside its neighbourhood.

    ``cells`` (gx, gy, sx, sy, m) are sums over a grid of 2**levels by 2**levels. On each level of the pyramid a cell
    meets the children of its parent's neighbours that aren't its own neighbours, at most 27, by equality joins;
    forces then go down from parents to children. The work is in proportion to the cells.
    """
    down = None
    for level in range(2, levels + 1):
        half = 1 << (levels - level)
        c = cells.groupBy(F.floor(F.col("gx") / half).alias("cx"), F.floor(F.col("gy") / half).alias("cy")).agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("m").alias("m"))
        c = stored(c.select("cx", "cy", (F.col("sx") / F.col("m")).alias("x"), (F.col("sy") / F.col("m")).alias("y"), "m"), "pyramid")
        offsets = F.expr("explode(flatten(transform(sequence(-3, 3), i -> transform(sequence(-3, 3), j -> struct(i, j)))))")
        asked = c.select("cx", "cy", "x", "y", offsets.alias("o")).filter("abs(o.i) > 1 or abs(o.j) > 1").withColumns({"px": F.col("cx") + F.col("o.i"), "py": F.col("cy") + F.col("o.j")})
        asked = asked.filter("abs(floor(px / 2) - floor(cx / 2)) <= 1 and abs(floor(py / 2) - floor(cy / 2)) <= 1")
        there = c.select(F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("x").alias("ox"), F.col("y").alias("oy"), "m")
        fx, fy = _push(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("m"), repulsion)
        own = c.select("cx", "cy").join(asked.join(there, ["px", "py"]).groupBy("cx", "cy").agg(F.sum(fx).alias("fx"), F.sum(fy).alias("fy")), ["cx", "cy"], "left").fillna(0.0)
        if down is not None:
            up = down.select(F.col("gx").alias("ux"), F.col("gy").alias("uy"), F.col("fx").alias("ufx"), F.col("fy").alias("ufy"))
            own = own.join(up, (F.floor(F.col("cx") / 2) == F.col("ux")) & (F.floor(F.col("cy") / 2) == F.col("uy"))).select("cx", "cy", (F.col("fx") + F.col("ufx")).alias("fx"), (F.col("fy") + F.col("ufy")).alias("fy"))
        down = own.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "fx", "fy")
    return down if down is not None else cells.select("gx", "gy", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))


def force_tick(state: DataFrame, edges: DataFrame, repulsion: float = 200.0, attraction: float = 0.05, centering: float = 0.2, alpha: float = 0.2, levels: int | None = None) -> DataFrame:
    """(id, x, y, vx, vy) after one tick of (id, x, y, vx, vy) with unit masses.

    Repulsion of nodes in the same or a neighbouring cell of a grid is exact, by a join on cells; the rest comes
    from ``far_field``. Springs are two joins on the links' ends and one aggregation. The grid has 2**levels cells a
    side, by default as many as put about sixteen nodes in a cell; with 0 or 1 levels all repulsion is exact.
    """
    s = stored(state.select("id", "x", "y", "vx", "vy"), "force")
    n, x0, x1, y0, y1, mx, my = s.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.avg("x"), F.avg("y")).first()
    if not n:
        return s
    levels = max(0, round(math.log(max(n / 16, 1), 4))) if levels is None else levels
    cell = max(x1 - x0, y1 - y0, 1e-6) * (1 + 1e-9) / (1 << levels)
    g = s.withColumns({"gx": F.floor((F.col("x") - x0) / cell), "gy": F.floor((F.col("y") - y0) / cell)})
    around = F.expr("explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(gx + i as gx, gy + j as gy)))))")
    near = g.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), around.alias("g")).select("o", "ox", "oy", "g.gx", "g.gy")
    fx, fy = _push(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), 1.0, repulsion)
    close = g.join(near, ["gx", "gy"]).filter("id <> o").groupBy("id").agg(F.sum(fx).alias("cfx"), F.sum(fy).alias("cfy"))
    cells = stored(g.groupBy("gx", "gy").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("m")), "cells")
    far = far_field(cells, levels, repulsion)
    e = edges.filter("source <> target")
    at = lambda c, p: s.select(F.col("id").alias(c), F.col("x").alias(p + "x"), F.col("y").alias(p + "y"))
    span = e.join(at("source", "s"), "source").join(at("target", "t"), "target").select("source", "target", (F.col("tx") - F.col("sx")).alias("dx"), (F.col("ty") - F.col("sy")).alias("dy"))
    ends = span.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("dx"), F.col("dy")), F.struct(F.col("target").alias("id"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")))).alias("e")).groupBy("e.id").agg(F.sum("e.dx").alias("dx"), F.sum("e.dy").alias("dy"), F.count("*").alias("deg"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    all_ = g.join(close, "id", "left").join(far.select("gx", "gy", F.col("fx").alias("ffx"), F.col("fy").alias("ffy")), ["gx", "gy"], "left").join(ends, "id", "left")
    stab = 1 / (1 + DAMPING * alpha * attraction * F.coalesce("deg", F.lit(0)))
    vel = lambda v, p, c, f, d, m: (F.col(v) + (zero(c) + zero(f) + attraction * zero(d) + centering * (m - F.col(p))) * alpha) * DAMPING * stab
    moved = all_.select("id", "x", "y", vel("vx", "x", "cfx", "ffx", "dx", mx).alias("vx"), vel("vy", "y", "cfy", "ffy", "dy", my).alias("vy"))
    cap = STEP_CAP * equilibrium_spacing(repulsion, centering)
    k = F.least(F.lit(1.0), cap / F.greatest(F.hypot("vx", "vy"), F.lit(1e-12)))
    return moved.select("id", (F.col("x") + F.col("vx") * k).alias("x"), (F.col("y") + F.col("vy") * k).alias("y"), (F.col("vx") * k).alias("vx"), (F.col("vy") * k).alias("vy"))


def force_frames(state: DataFrame, edges: DataFrame, ticks: int, every: int = 5, **params):
    """Yields the state every few ticks, and at the end once the mean step is settled."""
    spacing = equilibrium_spacing(params.get("repulsion", 200.0), params.get("centering", 0.2))
    last = float("inf")
    for tick in range(1, ticks + 1):
        state = stored(force_tick(state, edges, **params), "force")
        step = state.agg(F.avg(F.hypot("vx", "vy"))).first()[0] or 0.0
        settled = tick >= 30 and step < 0.06 * spacing and step <= last
        if tick % every == 0 or settled or tick == ticks:
            yield tick, state
        if settled:
            return
        last = step


def rank_in(df: DataFrame, by: str, order: list) -> DataFrame:
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))
