"""Queries over glyphs: styles, links, frontiers, picks, labels, SVG text, versors and fitted projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import labels as B
from gridloom.functions import versor as Q
from gridloom.functions.projection import Projection
from gridloom.operators import frontier as R
from gridloom.operators import glyphs as Y
from gridloom.operators import graph
from gridloom.operators import hierarchy as H
from gridloom.operators import iterate as I
from gridloom.operators import scene, validate
from gridloom.operators import view as V
from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import with_
from gridloom.plans.geo_queries import GEO, _geo
from gridloom.plans.graph_queries import G1_LINKS
from gridloom.plans.view_queries import DISCS, ON_SCREEN, _greedy
from gridloom.sources import svg

NEAR = V.View(k=0.2, x=100, y=-200, width=800, height=600)
DEGREES = G1_LINKS + """, ge AS (SELECT source AS id, weight FROM g1 UNION ALL SELECT target, weight FROM g1 WHERE source <> target),
n AS (SELECT g1n.id, count(ge.id) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS strength FROM g1n LEFT JOIN ge ON ge.id = g1n.id GROUP BY g1n.id)
"""


def _nodes(spark, sf_dir):
    return graph.degree_strength(X.g1_nodes(spark), X.g1_links(spark, sf_dir))


def _root(v):
    return F.sqrt(v.cast("double")) / 2


@query(DEGREES + "SELECT id, 3.5::DOUBLE AS flat, round(2 + sqrt(degree), 6) AS by_degree, round(sqrt(strength) / 2, 6) AS by_strength, CAST(strength AS DOUBLE) AS adds FROM n")
def node_radii(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    rule = Y.radius_rule(n, {"by": "strength", "scale": _root})
    return n.select("id", Y.node_radius(n, 3.5).alias("flat"), F.round(Y.node_radius(n, lambda d: 2 + F.sqrt(d.cast("double"))), 6).alias("by_degree"), F.round(Y.node_radius(n, {"by": "strength", "scale": _root}), 6).alias("by_strength"), rule[0].alias("adds"))


@query(DEGREES + "SELECT id, CAST(strength AS DOUBLE) AS from_size, 1.0::DOUBLE AS flat, CAST(degree AS DOUBLE) AS given, CAST(degree * 2 - strength AS DOUBLE) AS own FROM n")
def node_importance(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return n.select("id", Y.importance(n, None, {"by": "strength", "scale": _root}).alias("from_size"), Y.importance(n).alias("flat"), Y.importance(n, "degree").alias("given"), Y.importance(n, F.col("degree") * 2 - F.col("strength")).alias("own"))


def _hex(channels):
    return "'#' || " + " || ".join(f"lpad(lower(hex(CAST(floor({c} + 0.5) AS BIGINT))), 2, '0')" for c in channels)


RAMP = [f"({a} + t * {b - a})" for a, b in ((16, 200), (32, 100), (48, 0))]


@query(f"WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS w, least(greatest((l_quantity - 5) / 40.0, 0), 1) AS t FROM lineitem) SELECT id, round(sqrt(w) / 2, 6) AS width, 2.0::DOUBLE AS flat, {_hex(RAMP)} AS color FROM l")
def link_styles(spark, sf_dir):
    w = F.col("w")
    rows = X.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("w"))
    color = Y.by_weight(Y.ramp("#102030", "#c86400", 5, 45))(w)
    return rows.select("id", F.round(Y.by_weight({"by": "weight", "scale": _root})(w), 6).alias("width"), Y.by_weight(2.0)(w).alias("flat"), color.alias("color"))


@query(DEGREES + f"SELECT id, '#888888' AS plain, {_hex(RAMP)} AS by_degree FROM (SELECT *, least(greatest((degree - 5) / 40.0, 0), 1) AS t FROM n)")
def node_fills(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return n.select("id", Y.node_fill(n, None, "#888888").alias("plain"), Y.node_fill(n, {"by": "degree", "scale": Y.ramp("#102030", "#c86400", 5, 45)}, "#888888").alias("by_degree"))


@query(with_("h", "SELECT id, CASE WHEN path[2] % 2 = 0 THEN '#aa00' || lpad(CAST(path[2] AS VARCHAR), 2, '0') ELSE '#cccccc' END AS fill FROM h"))
def module_fills(spark, sf_dir):
    h = X.hierarchy(spark, sf_dir)
    colors = h.select(F.slice("path", 1, 2).alias("path")).distinct().filter("path[1] % 2 = 0").withColumn("color", F.concat(F.lit("#aa00"), F.lpad(F.col("path")[1].cast("string"), 2, "0")))
    return Y.module_fill(h, colors, "#cccccc")


@query(with_("p", ", b AS (SELECT id, radius, y / 10007 AS share FROM p) SELECT id, round(radius - radius * sqrt(1 - least(greatest(share, 0), 1)), 6) AS share_width, round(sqrt(share * 10007) / 10, 6) AS scaled_width, '#2c4258' AS border_color FROM b"))
def flow_borders(spark, sf_dir):
    n = X.points(spark, sf_dir).select("id", "radius", F.col("y").alias("exit"), F.lit(10007.0).alias("flow"), F.lit("#3f5e7e").alias("fill"))
    share = Y.flow_border(n, F.col("exit"), share=True).select("id", F.round("border_width", 6).alias("share_width"), "border_color")
    scaled = Y.flow_border(n, F.col("exit"), lambda v: F.sqrt(v) / 10).select("id", F.round("border_width", 6).alias("scaled_width"))
    return share.join(scaled, "id")


LINES = "FROM g2 JOIN p a ON a.id = source JOIN p b ON b.id = target"


@query(with_("g2 p", f"SELECT edge_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, CAST(3 * weight AS DOUBLE) AS width, '#999999' AS color, 0.25::DOUBLE AS bend, b.radius {LINES}"))
def link_lines(spark, sf_dir):
    return Y.link_lines(X.g2(spark, sf_dir), X.points(spark, sf_dir), lambda w: 3 * w, "#999999", 0.25, heads=True)


@query(with_("g2 p", f", back AS (SELECT DISTINCT target AS source, source AS target FROM g2) SELECT edge_id, a.x AS x0, b.x AS x1, a.radius AS r0, b.radius AS r1, CASE WHEN back.source IS NOT NULL AND g2.source <> g2.target THEN 3.0 ELSE 0.0 END::DOUBLE AS opposite_width FROM g2 LEFT JOIN back USING (source, target) JOIN p a ON a.id = g2.source JOIN p b ON b.id = g2.target"))
def half_arrows(spark, sf_dir):
    out = Y.half_arrows(X.g2(spark, sf_dir), X.points(spark, sf_dir), lambda w: 3 * w, "#999999")
    return out.select("edge_id", "x0", "x1", "r0", "r1", "opposite_width")


def _frontier(spark, sf_dir):
    """Nations of regions 2 and 3 as aggregates, customers of region 4 as leaves, with positions by path."""
    h, p = X.hierarchy(spark, sf_dir), X.points(spark, sf_dir)
    at = h.join(p, "id").withColumn("is_leaf", F.col("path")[0] == 4).filter("path[0] in (2, 3, 4)")
    cell = F.when(F.col("is_leaf"), F.col("path")).otherwise(F.slice("path", 1, 2))
    return at.groupBy(cell.alias("path"), "is_leaf").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.max("radius") * F.count("*")).alias("radius"), F.count("*").alias("count"), F.min("id").alias("pos"))


CELLS = ", f AS (SELECT CASE WHEN path[1] = 4 THEN path ELSE path[1:2] END AS path, path[1] = 4 AS is_leaf, avg(x) AS cx, avg(y) AS cy, max(radius) * count(*) AS radius, count(*) AS n, min(id) AS pos FROM h JOIN p USING (id) WHERE path[1] IN (2, 3, 4) GROUP BY 1, 2)"


@query(with_("h p", CELLS + " SELECT array_to_string(path, ':') AS path, round(cx, 4) AS cx, round(CASE WHEN is_leaf OR n = 1 THEN radius ELSE least(radius, 40) END, 6) AS r, CASE WHEN is_leaf OR n = 1 THEN '#112233' ELSE '#445566' END AS fill, CAST(128 AS INTEGER) AS alpha FROM f"))
def frontier_circles(spark, sf_dir):
    out = Y.frontier_circles(_frontier(spark, sf_dir), "#112233", "#445566", 40.0, F.lit(0.5))
    return out.select(F.array_join("path", ":").alias("path"), F.round("cx", 4).alias("cx"), F.round("r", 6).alias("r"), "fill", "alpha")


@query(with_("h p", CELLS + " SELECT array_to_string(path, ':') AS path, round(least(radius, 40) + 5, 6) AS r, round(2 / (least(radius, 40) + 5), 6) AS border, CAST(204 AS INTEGER) AS alpha FROM f WHERE NOT is_leaf AND n > 1"))
def frontier_halos(spark, sf_dir):
    out = Y.frontier_halos(_frontier(spark, sf_dir), gap=3.0, width=2.0, opacity=0.8, largest=40.0)
    return out.select(F.array_join("path", ":").alias("path"), F.round("r", 6).alias("r"), F.round("border", 6).alias("border"), "alpha")


@query(with_("h p", CELLS + ", e AS (SELECT path, cx, cy, CAST(200 + 40 * radius AS DOUBLE) AS extent, CASE WHEN n % 2 = 0 THEN 4.0 ELSE 0.0 END AS w FROM f WHERE NOT is_leaf) SELECT array_to_string(path, ':') AS path, round(extent, 4) AS r, round(least(w / 0.2 / extent, 1), 6) AS border FROM e WHERE w > 0 AND (extent - w / 0.2 <= 0 OR greatest(abs(-500 - cx), abs(3500 - cx)) ** 2 + greatest(abs(1000 - cy), abs(4000 - cy)) ** 2 >= (extent - w / 0.2) ** 2)"))
def boundary_rings(spark, sf_dir):
    f = _frontier(spark, sf_dir).filter("not is_leaf").withColumn("extent", 200 + 40 * F.col("radius"))
    out = Y.boundary_rings(f, F.when(F.col("count") % 2 == 0, 4.0).otherwise(0.0), NEAR)
    return out.select(F.array_join("path", ":").alias("path"), F.round("r", 4).alias("r"), F.round("border", 6).alias("border"))


@query(with_("h p", CELLS + ", d AS (SELECT *, CASE WHEN is_leaf THEN radius ELSE least(radius, 300) END AS r FROM f) SELECT arg_max(array_to_string(path, ':'), pos) AS path FROM d WHERE (300 - (cx * 0.2 + 100)) ** 2 + (400 - (cy * 0.2 - 200)) ** 2 <= r * r"))
def pick_frontier(spark, sf_dir):
    return Y.pick_frontier(_frontier(spark, sf_dir), 300, 400, NEAR, largest=300.0).select(F.array_join("path", ":").alias("path"))


BOTH = ", st AS (SELECT id, x, y, radius FROM p WHERE id % 2 = 0), ph AS (SELECT id, x, y, radius * 6 AS radius FROM p WHERE id % 2 = 1)"


def _both(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return p.filter("id % 2 = 0"), p.filter("id % 2 = 1").withColumn("radius", F.col("radius") * 6)


@query(with_("p", BOTH + ", hit AS (SELECT 0 AS o, 'state' AS kind, max(id) AS id FROM st WHERE (x * 0.2 + 100 - 400) ** 2 + (y * 0.2 - 200 - 300) ** 2 <= (radius * 0.2) ** 2 UNION ALL SELECT 1, 'physical', max(id) FROM ph WHERE (x * 0.2 + 100 - 400) ** 2 + (y * 0.2 - 200 - 300) ** 2 <= (radius * 0.2) ** 2) SELECT kind, id FROM hit WHERE id IS NOT NULL ORDER BY o LIMIT 1"))
def pick_both(spark, sf_dir):
    return R.pick_both(*_both(spark, sf_dir), 400, 300, NEAR)


@query(with_("p", BOTH + " SELECT 'state' AS kind, id FROM st WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 1500 AND 2500 UNION ALL SELECT 'physical', id FROM ph WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 1500 AND 2500"))
def region_both(spark, sf_dir):
    return R.region_both(*_both(spark, sf_dir), (100, 100, 300, 300), NEAR)


@query("WITH d AS (SELECT p_partkey AS id, (p_size - 10.0) ** 2 + (p_partkey % 17 + 1 - 4.5) ** 2 AS d FROM part), a AS (SELECT max(id) AS id FROM d WHERE id % 3 = 0 AND d <= 9), b AS (SELECT max(id) AS id FROM d WHERE id % 3 = 1 AND d <= 9), c AS (SELECT max(id) AS id FROM d WHERE id % 3 = 2 AND d <= 0.01) SELECT * FROM (SELECT 'b' AS layer, CAST(id AS VARCHAR) AS id FROM b WHERE id IS NOT NULL AND (SELECT id FROM a) IS NOT NULL UNION ALL SELECT 'a', CAST(id AS VARCHAR) FROM a WHERE id IS NOT NULL AND (SELECT id FROM b) IS NULL) LIMIT 1")
def pick_layers(spark, sf_dir):
    """Three layers of discs, bottom to top a, b, c: b is clipped to a; c, on top, to b, and has only tiny discs."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 17 + 1).cast("double"))).alias("points"))
    layer = lambda k, r: p.filter(F.col("id") % 3 == k).select(F.col("id").alias("ord"), "id", F.lit("circle").alias("kind"), "points", F.lit(0.0).alias("half_width"), F.lit(r).alias("radius"), F.lit(False).alias("hidden"))
    return scene.pick_layers([("a", layer(0, 3.0), None), ("b", layer(1, 3.0), "a"), ("c", layer(2, 0.1), "b")], 10.0, 4.5)


@query(with_("p", "SELECT id FROM p WHERE x BETWEEN -500 AND 3500 AND y BETWEEN 1000 AND 4000"))
def candidates_in_view(spark, sf_dir):
    grid, cell = Y.candidate_grid(X.points(spark, sf_dir))
    return Y.candidates(grid, cell, NEAR)


@query("SELECT c_custkey AS id, c_acctbal * 2 + 10 AS x, CAST(c_nationkey AS DOUBLE) AS y, CAST(1 + c_custkey % 5 AS DOUBLE) AS radius, CASE WHEN c_mktsegment = 'BUILDING' THEN '#ff0000' ELSE '#0000ff' END AS fill FROM customer WHERE c_acctbal > 0")
def project_points(spark, sf_dir):
    bal = F.col("c_acctbal")
    return Y.project_points(X.table(spark, sf_dir, "customer"), "c_custkey", F.when(bal > 0, bal * 2 + 10), F.col("c_nationkey"), 1 + F.col("c_custkey") % 5, F.when(F.col("c_mktsegment") == "BUILDING", "#ff0000").otherwise("#0000ff"))


@query(with_("p", "SELECT id, x, radius FROM p WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"))
def gather_points(spark, sf_dir):
    ids = X.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return Y.gather(X.points(spark, sf_dir), ids).select("id", "x", "radius")


@query("SELECT l_suppkey AS segment, CAST(sum(l_quantity) AS BIGINT) AS sum, CAST(min(l_quantity) AS BIGINT) AS min, CAST(max(l_quantity) AS BIGINT) AS max, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def segment_reduce(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return Y.segment_reduce(rows, "l_suppkey", "q")


@query(with_("h p", ", f AS (SELECT o_custkey AS id, CAST(count(*) AS DOUBLE) AS flow FROM orders GROUP BY 1) SELECT h.id, x, h.id % 7 = 0 AS selected, coalesce(f.flow, -1.0) AS flow, CASE WHEN h.id % 2 = 0 THEN '1:' || CAST(h.id AS VARCHAR) ELSE array_to_string(path, ':') END AS path FROM h JOIN p USING (id) LEFT JOIN f ON f.id = h.id"))
def live_update(spark, sf_dir):
    h, p = X.hierarchy(spark, sf_dir), X.points(spark, sf_dir)
    nodes = h.join(p.select("id", "x", "y"), "id").withColumns({"selected": F.col("id") % 7 == 0, "flow": F.lit(-1.0)})
    flow = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("flow"))
    modules = h.filter("id % 2 = 0").select("id", F.array(F.lit(1).cast("long"), F.col("id").cast("long")).alias("path"))
    return Y.live_update(nodes, flow, modules).select("id", "x", "selected", "flow", F.array_join("path", ":").alias("path"))


@query(G1_LINKS + "SELECT id, CAST(id AS DOUBLE) AS x, CAST(id * 3 % 101 AS DOUBLE) AS y, 0.0::DOUBLE AS vx FROM g1n WHERE id % 5 = 0")
def pinned_tick(spark, sf_dir):
    """A force tick with every fifth node pinned: those stay at rest."""
    state = X.g1_nodes(spark).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 3 % 101).cast("double").alias("y"), F.lit(1.0).alias("vx"), F.lit(1.0).alias("vy"))
    pinned = state.filter("id % 5 = 0").select("id")
    moved = Y.hold_pinned(I.force_tick(state, X.g1_links(spark, sf_dir), levels=2), state, pinned)
    return moved.join(pinned, "id", "left_semi").select("id", "x", "y", "vx")


def _angles(k):
    return [(k * m % 360 - 180).cast("double") for m in (1, 7, 31)]


VERSOR = """WITH e AS (SELECT p_partkey AS id, radians(CAST(p_partkey % 360 - 180 AS DOUBLE)) / 2 AS l, radians(CAST(p_partkey * 7 % 360 - 180 AS DOUBLE)) / 2 AS p, radians(CAST(p_partkey * 31 % 360 - 180 AS DOUBLE)) / 2 AS g FROM part),
q AS (SELECT id, cos(l) * cos(p) * cos(g) + sin(l) * sin(p) * sin(g) AS w, sin(l) * cos(p) * cos(g) - cos(l) * sin(p) * sin(g) AS x, cos(l) * sin(p) * cos(g) + sin(l) * cos(p) * sin(g) AS y, cos(l) * cos(p) * sin(g) - sin(l) * sin(p) * cos(g) AS z FROM e)
"""


@query(VERSOR + "SELECT id, round(w, 6) + 0.0 AS w, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(degrees(asin(greatest(-1.0, least(1.0, 2 * (w * y - z * x))))), 3) + 0.0 AS phi FROM q")
def versor_from_angles(spark, sf_dir):
    k = F.col("p_partkey")
    q = X.table(spark, sf_dir, "part").select(k.alias("id"), *[c.alias(n) for c, n in zip(Q.from_angles(*_angles(k)), "wxyz")])
    phi = Q.to_angles(tuple(F.col(c) for c in "wxyz"))[1]
    return q.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in "wxyz"], (F.round(phi, 3) + 0.0).alias("phi"))


@query("SELECT p_partkey AS id, 1.0::DOUBLE AS size, round(sin(radians(p_size)), 6) AS cross FROM part")
def versor_turn(spark, sf_dir):
    """A half turn twice is the whole turn; a turn along the equator by p_size degrees has its sine."""
    v, u = Q.direction(F.lit(0.0), F.lit(0.0)), Q.direction(F.col("p_size").cast("double"), F.lit(0.0))
    half = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[c.alias(n) for c, n in zip(Q.turn(v, u, 0.5), "wxyz")])
    p = tuple(F.col(c) for c in "wxyz")
    w, x, y, z = Q.product(p, p)
    return half.select("id", F.round(w * w + x * x + y * y + z * z, 6).alias("size"), F.round(F.abs(2 * w * F.sqrt(x * x + y * y + z * z)), 6).alias("cross"))


@query(f"WITH {GEO}, m AS (SELECT id, radians(lon) AS x, -radians(lat) AS y FROM geo), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m), k AS (SELECT *, least(800 / (x1 - x0), 600 / (y1 - y0)) AS k FROM b) SELECT id, round(k * x + (800 - k * (x0 + x1)) / 2, 4) AS x, round(k * y + (600 - k * (y0 + y1)) / 2, 4) AS y FROM m, k")
def fit_projection(spark, sf_dir):
    g = _geo(spark, sf_dir)
    x, y = Q.fit_projection(g, "equirectangular", 800, 600).forward(F.col("lon"), F.col("lat"))
    return g.select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("SELECT r_regionkey AS id, r_regionkey % 2 = 0 AS is_orthographic FROM region")
def orthographic_test(spark, sf_dir):
    """Even regions ask an orthographic projection, odd ones an equirectangular one with the same settings."""
    import math

    def forward(kind, k):
        def at(lon, lat):
            l, p = math.radians(lon - k), math.radians(lat)  # noqa: E741
            if kind == "plain":
                return 400 + 100 * l, 300 - 100 * p
            return (400 + 100 * math.cos(p) * math.sin(l), 300 - 100 * math.sin(p)) if math.cos(p) * math.cos(l) >= 0 else None

        return at

    keys = [r[0] for r in X.table(spark, sf_dir, "region").select("r_regionkey").collect()]  # five regions
    rows = [(int(k), Q.is_orthographic(forward("plain" if k % 2 else "globe", k), 100, 400, 300, lon0=k)) for k in keys]
    return spark.createDataFrame(rows, X.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit(True).alias("is_orthographic")).schema)


@query("SELECT p_partkey AS id, CAST(ceil(length(p_name) * (p_size * 0.55::DOUBLE)) AS BIGINT) AS width, CAST(ceil(p_size * 1.25) AS BIGINT) AS height, '600 ' || p_size || 'px system-ui' AS font FROM part")
def measure_text(spark, sf_dir):
    css = F.concat(F.lit("600 "), F.col("p_size").cast("string"), F.lit("px / 1.2 system-ui"))
    w, h = B.measure(F.col("p_name"), css)
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), w.alias("width"), h.alias("height"), B.canvas_font(css).alias("font"))


LABELS = """WITH l AS (SELECT p_partkey AS id, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST(p_partkey % 89 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS w, 12.0::DOUBLE AS h, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 7 AS DOUBLE) END AS rot, ['start', 'middle', 'end'][p_partkey % 3 + 1] AS anchor, p_partkey % 2 = 0 AS up FROM part),
f AS (SELECT *, coalesce(rot IS NOT NULL AND up AND cos(rot) < 0, false) AS flip FROM l), s AS (SELECT *, CASE WHEN flip THEN CASE anchor WHEN 'start' THEN 'end' WHEN 'end' THEN 'start' ELSE 'middle' END ELSE anchor END AS side, coalesce(CASE WHEN flip THEN rot + pi() ELSE rot END, 0) AS a FROM f),
e AS (SELECT *, CASE side WHEN 'start' THEN 0 WHEN 'end' THEN -w ELSE -w / 2 END AS lx, CASE WHEN rot IS NOT NULL THEN -h / 2 ELSE 0 END AS ly FROM s), k AS (SELECT id, side, unnest([[lx, ly], [lx + w, ly], [lx + w, ly + h], [lx, ly + h]]) AS c, x, y, a FROM e)
"""


@query(LABELS + "SELECT id, side, round(min(x + c[1] * cos(a) - c[2] * sin(a)), 6) AS x0, round(max(x + c[1] * cos(a) - c[2] * sin(a)), 6) AS x1, round(min(y + c[1] * sin(a) + c[2] * cos(a)), 6) AS y0, round(max(y + c[1] * sin(a) + c[2] * cos(a)), 6) AS y1 FROM k GROUP BY id, side")
def label_geometry(spark, sf_dir):
    key = F.col("p_partkey")
    num = lambda c: c.cast("double")
    side = F.element_at(F.array(F.lit("start"), F.lit("middle"), F.lit("end")), (key % 3 + 1).cast("int"))
    rows = X.table(spark, sf_dir, "part").select(key.alias("id"), num(key % 97).alias("x"), num(key % 89).alias("y"), num(F.col("p_size")).alias("w"), F.when(key % 4 != 0, num(key % 7)).alias("rot"), side.alias("anchor"), (key % 2 == 0).alias("up"))
    quad = B.corners(F.col("x"), F.col("y"), F.col("w"), F.lit(12.0), F.col("rot"), F.col("anchor"), F.lit("top"), F.col("up"))
    x0, x1, y0, y1 = B.bounds(quad)
    return rows.select("id", B.rendered(F.col("rot"), F.col("anchor"), F.col("up"))[1].alias("side"), *[F.round(c, 6).alias(n) for c, n in ((x0, "x0"), (x1, "x1"), (y0, "y0"), (y1, "y1"))])


@query("SELECT p_partkey AS id, '<text x=\"' || p_size || '\" y=\"7\" text-anchor=\"middle\" dominant-baseline=\"central\" style=\"font:12px sans-serif\" fill=\"#000\">' || replace(replace(replace(p_name || ' & <b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text>' AS value FROM part")
def svg_labels(spark, sf_dir):
    text = svg.label(F.col("p_size"), F.lit(7), F.concat("p_name", F.lit(" & <b>")), F.lit("middle"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("value"))


@query("SELECT p_partkey AS id, '<path d=\"M0,0L' || p_size || ',' || CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 17) || '.5' ELSE CAST(p_partkey % 17 AS VARCHAR) END || 'L3,4Z\" fill=\"' || CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE 'rgba(1, 2, 3, 1.0000)' END || '\"' || CASE WHEN p_partkey % 3 = 0 THEN ' stroke=\"red\" stroke-width=\"1.5\"' ELSE '' END || ' />' AS value FROM part")
def svg_paths(spark, sf_dir):
    k, pen = F.col("p_partkey"), F.col("p_partkey") % 3 == 0
    y = (k % 17).cast("double") + F.when(k % 2 == 0, 0.5).otherwise(0.0)
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.col("p_size").cast("double"), y), F.array(F.lit(3.0), F.lit(4.0)))
    full = svg.rgba(F.lit(1), F.lit(2), F.lit(3), F.lit(255))
    value = svg.path(svg.path_d(ring, True), F.when(~pen, full), F.when(pen, "red"), F.when(pen, 1.5))
    return X.table(spark, sf_dir, "part").select(k.alias("id"), value.alias("value"))


@query("SELECT part, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(value)) AS BIGINT) AS chars FROM (SELECT CAST(3 AS INTEGER) AS part, '<circle cx=\"' || p_size || '\" cy=\"' || (p_partkey % 17) || '\" r=\"2\" fill=\"#123\" />' AS value FROM part UNION ALL SELECT * FROM (VALUES (0, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"800\" height=\"600\" viewBox=\"0 0 800 600\"><defs>'), (2, '</defs><g transform=\"translate(100, -200) scale(0.2)\">'), (100, '</g>'), (300, '</svg>'))) GROUP BY part")
def svg_document(spark, sf_dir):
    dots = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), svg.circle(F.col("p_size"), F.col("p_partkey") % 17, F.lit(2), F.lit("#123")).alias("value"))
    return svg.document(NEAR, [dots]).groupBy("part").agg(F.count("*").alias("lines"), F.sum(F.length("value")).cast("long").alias("chars"))


@query(with_("h", "SELECT array_to_string(path[1:2], ':') AS path, round(10 * sqrt(count(*)), 6) AS root_radius, round(1 - pow(0.001, 1.0 / count(*)), 9) AS decay FROM h GROUP BY 1"))
def nested_bounds(spark, sf_dir):
    from gridloom.operators.layout import nested_alpha_decay, nested_root_radius

    n = X.hierarchy(spark, sf_dir).groupBy(F.slice("path", 1, 2).alias("path")).agg(F.count("*").alias("n"))
    return n.select(F.array_join("path", ":").alias("path"), F.round(nested_root_radius(F.col("n")), 6).alias("root_radius"), F.round(nested_alpha_decay(F.col("n")), 9).alias("decay"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE greatest(CAST(p_partkey % 4 AS DOUBLE), 1.0) END AS spacing FROM part")
def lod_spacing(spark, sf_dir):
    """The spacing of each part's settings; there are 20 of these."""
    known = [(s, d, Y.lod_spacing(d != 0, float(s))) for s in range(4) for d in range(5)]
    table = spark.createDataFrame(known, "s int, d int, spacing double")
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).cast("int").alias("s"), (F.col("p_partkey") % 5).cast("int").alias("d"))
    return p.join(table, ["s", "d"]).select("id", "spacing")


@query("SELECT p_partkey AS id, round(CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size >= 40 THEN 1.0 ELSE pow((p_size - 10) / 30.0, 2) * (3 - 2 * (p_size - 10) / 30.0) END, 9) AS s FROM part")
def smoothstep(spark, sf_dir):
    from gridloom.operators.frames import smoothstep as step

    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(step((F.col("p_size") - 10) / 30), 9).alias("s"))


@query("SELECT p_partkey AS id, p_size, round(degrees(CASE WHEN cos(p_partkey % 13) < 0 THEN 1 ELSE 0 END), 6) AS turned, [0, 1, 0] AS depths FROM part")
def ring_depths(spark, sf_dir):
    """An outline, its hole and a lone ring beside them; and which rotations are turned upright."""
    square = lambda x, r: F.array(*[F.array(F.lit(float(x + a * r)), F.lit(float(b * r))) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    rings = F.array(square(0, 10), square(0, 5), square(100, 3))
    a = (F.col("p_partkey") % 13).cast("double")
    turned = F.degrees(F.when(F.cos(G.upright(a)) * F.cos(a) < 0, 1.0).otherwise(0.0))
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.round(turned, 6).alias("turned"), G.ring_groups(rings).alias("depths"))


@query("SELECT p_partkey AS id, CAST(i AS INTEGER) AS i, round(3 * (1 - i / 16.0) ** 2 * (i / 16.0) * p_size + 3 * (1 - i / 16.0) * (i / 16.0) ** 2 * 20 + (i / 16.0) ** 3 * 30, 6) AS x FROM part, range(17) t(i)")
def flatten_curves(spark, sf_dir):
    point = lambda x, y: F.array(x, y)
    zero = F.lit(0.0)
    curve = G.cubic_points([point(zero, zero), point(F.col("p_size").cast("double"), zero), point(F.lit(20.0), zero), point(F.lit(30.0), zero)])
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(curve).alias("i", "p")).select("id", "i", F.round(F.col("p")[0], 6).alias("x"))


@query(with_("g2 p", f", d AS (SELECT edge_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d {LINES}) SELECT edge_id, CASE WHEN d > 0 THEN round(x1 - (x1 - x0) / d * 6 - (y1 - y0) / d * 2, 6) END AS left_x FROM d"))
def arrow_heads(spark, sf_dir):
    lines = Y.link_lines(X.g2(spark, sf_dir), X.points(spark, sf_dir))
    head = G.arrow_head(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 6.0, 2.0)
    return lines.select("edge_id", F.round(head[1][0], 6).alias("left_x"))


@query(with_("p", ", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), s AS (SELECT *, pow(2, ceil(log2(greatest(x1 - x0, y1 - y0) * 4 / 3))) AS side FROM b) SELECT side AS span, floor(x0 / (side / 4)) * (side / 4) AS x, floor(y0 / (side / 4)) * (side / 4) AS y FROM s"))
def morton_root_box(spark, sf_dir):
    from gridloom.functions.morton import root_box

    return spark.createDataFrame([tuple(float(v) for v in root_box(X.points(spark, sf_dir)))], "x double, y double, span double")


@query("SELECT true AS has_layout, true AS coincident_has_none, 'node 3 has no module record' AS why, true AS draws, false AS none_draws")
def validate_inputs(spark, sf_dir):
    """The checks before an update: what they find out, and what they say of a record that is missing."""
    p, h = X.points(spark, sf_dir), X.hierarchy(spark, sf_dir)
    why = ""
    validate.check_records(p, h)
    try:
        validate.check_records(p, h.filter("id <> 3"))
    except ValueError as e:
        why = str(e)
    one = p.select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    row = (validate.has_layout(p), not validate.has_layout(one), why, validate.draws_links(1.5), validate.draws_links("none"))
    return spark.createDataFrame([row], "has_layout boolean, coincident_has_none boolean, why string, draws boolean, none_draws boolean")


@query(with_("p", "SELECT id FROM p"))
def declutter_anchored_off(spark, sf_dir):
    """Without an exclusion radius every glyph is kept."""
    return Y.declutter_anchored(X.points(spark, sf_dir).select("id", F.col("id").alias("ord"), F.col("x").alias("ax"), F.col("y").alias("ay")), NEAR, 0.0)


SPOTS = ", a AS (SELECT id, floor(x / 500) * 500 AS ax, floor(y / 500) * 500 AS ay FROM p), s AS (SELECT min(id) AS id, ax * 0.2 + 100 AS x, ay * 0.2 - 200 AS y, 75.0 AS w, 0.0 AS h, ax, ay FROM a GROUP BY ax, ay)"


@query(
    _greedy(SPOTS, "id", ON_SCREEN, DISCS.format(s=1.0)).replace(" SELECT unnest(kept).id AS id", ", k AS (SELECT unnest(kept).id AS id", 1)
    + f" UNION ALL SELECT id FROM s WHERE NOT ({ON_SCREEN})) SELECT a.id FROM a JOIN s USING (ax, ay) WHERE s.id IN (SELECT id FROM k)"
)
def declutter_anchored(spark, sf_dir):
    """Glyphs on a coarse lattice of anchors, at least 150 pixels apart."""
    g = X.points(spark, sf_dir).select("id", F.col("id").alias("ord"), (F.floor(F.col("x") / 500) * 500.0).alias("ax"), (F.floor(F.col("y") / 500) * 500.0).alias("ay"))
    return Y.declutter_anchored(g, NEAR, 150.0)


@query(with_("h", "SELECT id, CAST(path[1] * 10 + len(path) AS BIGINT) AS key, 'r' || path[1] AS region FROM h"))
def path_metric(spark, sf_dir):
    """A metric of the caller's own, and the module key at the first level."""
    from gridloom.operators.styles import metric

    h = X.hierarchy(spark, sf_dir)
    return h.select("id", metric(h, (F.element_at("path", 1) * 10 + F.size("path")).cast("long")).alias("key"), F.concat(F.lit("r"), H.path_key("path", 1)).alias("region"))


@query(f"WITH {GEO} SELECT id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM geo")
def invert_equirectangular(spark, sf_dir):
    m = Projection("equirectangular", 100, 400, 300)
    g = _geo(spark, sf_dir)
    x, y = m.forward(F.col("lon"), F.col("lat"))
    lon, lat = m.inverse(F.col("x"), F.col("y"))
    return g.select("id", x.alias("x"), y.alias("y")).select("id", (F.round(lon, 4) + 0.0).alias("lon"), (F.round(lat, 4) + 0.0).alias("lat"))
