"""Queries over a view's frontier, module springs, packing and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators import frontier as R
from gridloom.operators import hierarchy as H
from gridloom.operators import iterate as I
from gridloom.operators import layout as L
from gridloom.operators import springs as M
from gridloom.operators import view as V
from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import with_
from gridloom.plans.hierarchy_queries import LINKS, _links
from gridloom.plans.view_queries import DECLUTTERED


def _frontier(records):
    """A fixed cut through H: region 1 whole, nations of regions 2 and 3, leaves of region 4; region 5 out of view."""
    top = F.element_at("path", 1)
    return records.select(F.when(top == 1, F.slice("path", 1, 1)).when(top < 4, F.slice("path", 1, 2)).when(top == 4, F.col("path")).alias("path"), (top == 4).alias("is_leaf")).filter("path is not null").distinct()


COVER = ", c AS (SELECT id, CASE WHEN path[1] = 1 THEN path[1:1] WHEN path[1] < 4 THEN path[1:2] WHEN path[1] = 4 THEN path ELSE path[1:1] END AS cover, path[1] = 4 AS leaf, path[1] <> 5 AS shown FROM h)"


@query(with_("h", COVER + " SELECT id, array_to_string(cover, ':') AS cover FROM c WHERE shown"))
def leaf_cover(spark, sf_dir):
    h = X.hierarchy(spark, sf_dir)
    return R.leaf_cover(h, _frontier(h)).select("id", F.array_join("cover", ":").alias("cover"))


@query(with_("h g2", COVER + " SELECT array_to_string(a.cover, ':') AS source, array_to_string(b.cover, ':') AS target, CAST(sum(weight) AS BIGINT) AS flow FROM g2 JOIN c a ON a.id = source JOIN c b ON b.id = target WHERE a.cover <> b.cover AND (a.shown OR b.shown) AND NOT (a.leaf AND b.leaf) GROUP BY a.cover, b.cover"))
def frontier_links(spark, sf_dir):
    h = X.hierarchy(spark, sf_dir)
    return R.frontier_links(h, X.g2(spark, sf_dir), _frontier(h)).select(F.array_join("source", ":").alias("source"), F.array_join("target", ":").alias("target"), "flow")


@query(DECLUTTERED)
def frontier_declutter(spark, sf_dir):
    """A frontier of leaves alone has no node above another, so that it thins as points do."""
    h = X.hierarchy(spark, sf_dir)
    n = h.join(X.points(spark, sf_dir), "id").select("id", "path", "x", "y", "radius", F.col("importance").alias("weight"), F.lit(True).alias("is_leaf"))
    return R.frontier_declutter(n, V.View(k=0.2, x=100, y=-200, width=800, height=600), spacing=2.0)


@query(with_("h g2", LINKS + ", r AS (SELECT src, dst, sum(flow) AS flow FROM m WHERE src <> dst GROUP BY ALL) SELECT array_to_string(src, ':') AS source, array_to_string(dst, ':') AS target, round(flow * (SELECT count(*) / sum(flow) FROM r), 6) AS weight FROM r"))
def module_springs(spark, sf_dir):
    return M.module_springs(_links(spark, sf_dir)).select(F.array_join("src", ":").alias("source"), F.array_join("dst", ":").alias("target"), F.round("weight", 6).alias("weight"))


@query(with_("h pre", "SELECT array_to_string(prefix, ':') AS path, count(*)::DOUBLE AS mass FROM pre GROUP BY prefix"))
def module_masses(spark, sf_dir):
    return M.module_masses(X.hierarchy(spark, sf_dir)).select(F.array_join("path", ":").alias("path"), "mass")


FORCES = LINKS + """, r AS (SELECT src, dst, sum(flow) AS flow FROM m WHERE src <> dst GROUP BY ALL), sp AS (SELECT src, dst, flow * (SELECT count(*) / sum(flow) FROM r) AS w FROM r),
c AS (SELECT prefix, avg(x) AS cx, avg(y) AS cy, count(*) AS mass FROM pre JOIN p USING (id) GROUP BY prefix),
f AS (SELECT src, dst, 0.05 * w * (b.cx - a.cx) AS fx, 0.05 * w * (b.cy - a.cy) AS fy FROM sp JOIN c a ON a.prefix = src JOIN c b ON b.prefix = dst),
pull AS (SELECT path, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT src AS path, fx, fy FROM f UNION ALL SELECT dst, -fx, -fy FROM f) GROUP BY path),
acc AS (SELECT pre.id, sum(fx / mass) AS ax, sum(fy / mass) AS ay FROM pre JOIN pull ON pull.path = pre.prefix JOIN c ON c.prefix = pre.prefix GROUP BY pre.id)
SELECT h.id, round(coalesce(ax, 0), 4) + 0.0 AS ax, round(coalesce(ay, 0), 4) + 0.0 AS ay FROM h LEFT JOIN acc USING (id)"""


@query(with_("h pre p g2", FORCES))
def module_forces(spark, sf_dir):
    out = M.module_forces(X.hierarchy(spark, sf_dir), X.points(spark, sf_dir), M.module_springs(_links(spark, sf_dir)))
    return out.select("id", (F.round("ax", 4) + 0.0).alias("ax"), (F.round("ay", 4) + 0.0).alias("ay"))


@query(with_("h pre p", "SELECT array_to_string(prefix, ':') AS path, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(sqrt(avg(x * x + y * y) - avg(x) ** 2 - avg(y) ** 2), 3) AS spread FROM pre JOIN p USING (id) GROUP BY prefix"))
def warm_start(spark, sf_dir):
    out = M.warm_start(X.hierarchy(spark, sf_dir), X.points(spark, sf_dir))
    return out.select(F.array_join("path", ":").alias("path"), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("spread", 3).alias("spread"))


@query()
def structural_tree(spark, sf_dir):
    nodes = X.g1_nodes(spark)
    return R.structural_tree(I.coarse_levels(nodes, X.g1_ordered(spark, sf_dir)), nodes)


@query()
def pack_states(spark, sf_dir):
    s = X.states(spark, sf_dir).select("physical", "state", (1 + F.col("state") % 3).cast("double").alias("radius"))
    return L.pack_states(s).select("physical", "state", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "r", "outer")])


@query("SELECT p_partkey AS id, 0 AS subpath, CAST(i AS INTEGER) AS ord, round(p_size + 2 * cos(2 * pi() * (i % 4) / 4 - pi() / 2), 6) + 0.0 AS x FROM part, range(5) t(i)")
def draw_polygons(spark, sf_dir):
    from gridloom.functions.draw import register

    register(spark)
    X.table(spark, sf_dir, "part").createOrReplaceTempView("gridloom_parts")
    return spark.sql("SELECT p_partkey AS id, subpath, ord, round(x, 6) + 0.0 AS x FROM gridloom_parts, LATERAL regular_polygon(CAST(p_size AS DOUBLE), 0.0D, 2.0D, 4)")


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 140 ELSE p_size * 7 END AS DOUBLE) AS h, CAST(CASE WHEN p_partkey % 3 = 0 THEN greatest(30, p_size) ELSE p_size END AS DOUBLE) AS c, CAST(p_size + 20 AS DOUBLE) AS l FROM part")
def hue_shift(spark, sf_dir):
    """Picked rows take a new hue and at least some chroma, and keep their lightness; others stay."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    shifted = C.shifted(size * 7, size, size + 20, k % 3 == 0, 140.0, 30.0)
    return X.table(spark, sf_dir, "part").select(k.alias("id"), *[v.alias(n) for n, v in zip("hcl", shifted)])


@query()
def multilevel_seed(spark, sf_dir):
    return L.multilevel_seed(X.g1_nodes(spark), X.g1_ordered(spark, sf_dir), 800, 600, ticks=1).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(with_("h", "SELECT array_to_string(path[1:1], ':') AS path, count(*) AS children FROM (SELECT DISTINCT path[1:2] AS path FROM h) GROUP BY 1"))
def child_counts(spark, sf_dir):
    return H.child_counts(X.hierarchy(spark, sf_dir)).filter("size(path) = 1").select(F.array_join("path", ":").alias("path"), "children")
