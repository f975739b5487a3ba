"""What a view's frontier needs besides its nodes: cover of all leaves, links between cover nodes, thinning, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import declutter as D
from gridloom.operators.hierarchy import closure
from gridloom.operators.view import View, pick_nodes, region_nodes


def leaf_cover(records: DataFrame, antichain: DataFrame) -> DataFrame:
    """(id, cover): the node of an antichain of paths that is each leaf or lies above it."""
    own = records.select("id", F.col("path").alias("at"))
    above = closure(records).select("id", F.col("prefix").alias("at"))
    return own.unionByName(above).join(antichain.select(F.col("path").alias("at")), "at").select("id", F.col("at").alias("cover"))


def culled_tops(records: DataFrame, frontier: DataFrame) -> DataFrame:
    """(path): the highest modules or leaves without any frontier node at or below them; with the frontier they
    cover every leaf once."""
    up = frontier.select("path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("d")).select(F.slice("path", 1, F.col("d")).alias("path"), (F.col("d") == F.size("path")).alias("own"))
    live = up.groupBy("path").agg(F.max("own").alias("own"))  # frontier nodes and what lies above them
    covered = leaf_cover(records, frontier).select("id")
    rest = records.join(covered, "id", "left_anti")
    chain = rest.select("id", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("d"), "path").withColumn("at", F.slice("path", 1, F.col("d")))
    dead = chain.join(live.select(F.col("path").alias("at")), "at", "left_anti")
    return dead.groupBy("id").agg(F.min_by("at", "d").alias("path")).select("path").distinct()


def frontier_links(records: DataFrame, edges: DataFrame, frontier: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(source, target, flow) by path between frontier nodes, and between them and what is out of view.

    Every edge is counted once, between the covers of its ends, at whatever levels these are; pairs of leaves are
    left to the leaf links, pairs out of view and within one cover are dropped. Module links (src, dst, flow) add to
    the covers of their ends where these lie at or above them.
    """
    shown = frontier.select("path", "is_leaf", F.lit(True).alias("shown"))
    cover_nodes = shown.unionByName(culled_tops(records, frontier).select("path", F.lit(False).alias("is_leaf"), F.lit(False).alias("shown")))
    cover = leaf_cover(records, cover_nodes)
    at = lambda c, p: cover.select(F.col("id").alias(c), F.col("cover").alias(p))
    flows = edges.filter("source <> target").join(at("source", "cs"), "source").join(at("target", "ct"), "target").select("cs", "ct", F.col("weight").alias("flow"))
    if links is not None:
        def covering(c: str, out: str) -> DataFrame:
            ends = links.select(F.col(c).alias("p")).distinct()
            chain = ends.select("p", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("d")).withColumn("at", F.slice("p", 1, F.col("d")))
            return chain.join(cover_nodes.select(F.col("path").alias("at")), "at").select(F.col("p").alias(c), F.col("at").alias(out))

        flows = flows.unionByName(links.join(covering("src", "cs"), "src").join(covering("dst", "ct"), "dst").select("cs", "ct", "flow"))
    sums = flows.filter("cs <> ct").groupBy("cs", "ct").agg(F.sum("flow").alias("flow"))
    flag = lambda c, p: cover_nodes.select(F.col("path").alias(c), F.col("is_leaf").alias(p + "leaf"), F.col("shown").alias(p + "shown"))
    j = sums.join(flag("cs", "s"), "cs").join(flag("ct", "t"), "ct")
    return j.filter("(sshown or tshown) and not (sleaf and tleaf)").select(F.col("cs").alias("source"), F.col("ct").alias("target"), "flow")


def frontier_declutter(nodes: DataFrame, view: View, spacing: float = 2.0, largest: float | None = None) -> DataFrame:
    """(id): frontier nodes (id, path, x, y, radius, weight, is_leaf) kept by weight, then id.

    Aggregates' radii are capped at ``largest`` pixels; a node and one above it (while levels fade) don't conflict.
    """
    from gridloom.plans.storage import dense_index, stored

    radius = F.col("radius") if largest is None else F.when(F.col("is_leaf"), F.col("radius")).otherwise(F.least("radius", F.lit(float(largest))))
    s = nodes.select("id", "path", (F.col("x") * view.k + view.x).alias("x"), (F.col("y") * view.k + view.y).alias("y"), F.greatest(radius, F.lit(0.0)).alias("r"), (-F.col("weight")).alias("ord"))
    on = F.col("x").between(0, view.width) & F.col("y").between(0, view.height) & ~F.isnan("x") & ~F.isnan("y")
    shown = stored(dense_index(s.filter(on), ["ord", "id"], "rank"), "frontier")
    reach = shown.agg(F.max("r")).first()[0]
    if not reach:
        return s.select("id")
    meet = D.discs_meet(spacing)

    def hit(a: tuple, b: tuple) -> bool:
        n = min(len(a[3]), len(b[3]))
        return meet(a, b) and list(a[3][:n]) != list(b[3][:n])

    return D.thinned(shown, 2 * spacing * reach, hit, ["x", "y", "r", "path"]).union(s.filter(~F.coalesce(on, F.lit(False))).select("id"))


def pick_both(states: DataFrame, physicals: DataFrame, px: float, py: float, view: View) -> DataFrame:
    """(kind, id): the state under a screen point, else the physical node."""
    hit = pick_nodes(states, px, py, view, False).select(F.lit(0).alias("p"), F.lit("state").alias("kind"), "id").unionByName(pick_nodes(physicals, px, py, view, False).select(F.lit(1).alias("p"), F.lit("physical").alias("kind"), "id"))
    return hit.filter("id is not null").orderBy("p").limit(1).select("kind", "id")


def region_both(states: DataFrame, physicals: DataFrame, rect: tuple[float, float, float, float], view: View) -> DataFrame:
    """(kind, id): states and physical nodes whose centres lie in a screen rectangle."""
    return region_nodes(states, rect, view).select(F.lit("state").alias("kind"), "id").unionByName(region_nodes(physicals, rect, view).select(F.lit("physical").alias("kind"), "id"))


def structural_tree(levels: list[tuple[DataFrame, DataFrame]], leaves: DataFrame) -> DataFrame:
    """(node, parent, level) of a coarsening hierarchy: leaves keep their ids, each level's groups follow the one
    below; groups are dense per level."""
    offset, out, n = 0, None, leaves.count()
    for level, (groups, _) in enumerate(levels):
        up = offset + n
        row = groups.select((F.col("id") + offset).alias("node"), (F.col("grp") + up).alias("parent"), F.lit(level).alias("level"))
        out = row if out is None else out.unionByName(row)
        offset, n = up, groups.select("grp").distinct().count()
    last = levels[-1][0].select((F.col("grp") + offset).alias("node")).distinct().select("node", F.lit(None).cast("long").alias("parent"), F.lit(len(levels)).alias("level")) if levels else leaves.select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level"))
    return last if out is None else out.unionByName(last)
