"""Queries over the hierarchies H and H-ragged."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import hierarchy as H
from gridloom.operators import links as L
from gridloom.operators import rollup as R
from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import with_

TREE = "hr pre tree"


@query(with_(TREE, "SELECT node, array_to_string(path, ':') AS path, CAST(depth AS INTEGER) AS depth, CAST(height AS INTEGER) AS height, first_record, leaves FROM tree", "hr"))
def module_tree(spark, sf_dir):
    t = H.module_tree(X.hierarchy(spark, sf_dir, ragged=True))
    return t.select("node", F.array_join("path", ":").alias("path"), "depth", "height", "first_record", "leaves")


@query(with_(TREE, "SELECT CAST(height AS INTEGER) AS level, count(*) AS nodes, min(node) AS first_node FROM tree GROUP BY height UNION ALL SELECT 0, count(*), 0 FROM hr", "hr"))
def module_levels(spark, sf_dir):
    r = X.hierarchy(spark, sf_dir, ragged=True)
    n = H.tree_nodes(r, H.module_tree(r))
    return n.groupBy("level").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"))


@query(
    with_(
        TREE,
        """, up AS (SELECT id AS node, path[1:len(path) - 1] AS up FROM hr UNION ALL SELECT node, path[1:depth - 1] FROM tree WHERE depth > 0)
SELECT u.node, t.node AS parent FROM up u JOIN tree t ON t.path = u.up UNION ALL SELECT node, NULL FROM tree WHERE depth = 0""",
        "hr",
    )
)
def tree_parents(spark, sf_dir):
    r = X.hierarchy(spark, sf_dir, ragged=True)
    return H.tree_nodes(r, H.module_tree(r)).select("node", "parent")


HUES = with_(
        "h",
        """, r AS (SELECT DISTINCT path[1] AS r FROM h), n AS (SELECT DISTINCT path[1] AS r, path[2] AS n FROM h),
a AS (SELECT r, (row_number() OVER (ORDER BY r) - 1) * 360.0 / count(*) OVER () AS s, 360.0 / count(*) OVER () AS w FROM r),
b AS (SELECT n.r, n.n, a.s + (row_number() OVER (PARTITION BY n.r ORDER BY n.n) - 1) * a.w / count(*) OVER (PARTITION BY n.r) AS s, a.w / count(*) OVER (PARTITION BY n.r) AS w FROM n JOIN a USING (r))
SELECT CAST(r AS VARCHAR) AS path, round((s + w / 2 + 20) % 360, 6) AS hue FROM a UNION ALL SELECT r || ':' || n, round((s + w / 2 + 20) % 360, 6) FROM b""",
    )


@query(HUES)
def module_hues(spark, sf_dir):
    return H.module_hues(X.hierarchy(spark, sf_dir)).select(F.array_join("path", ":").alias("path"), F.round("hue", 6).alias("hue"))


def _rgb_sql(hues: str) -> str:
    """SQL that turns (path, hue) of ``hues`` into colours at chroma 48 and lightness 65."""
    from gridloom.functions import color as C

    inverse = lambda t: f"CASE WHEN {t} > {C.LAB_1} THEN ({t}) ** 3 ELSE {3 * C.LAB_1 * C.LAB_1} * ({t} - {C.LAB_0}) END"
    fy = (65 + 16) / 116
    xyz = ", ".join(f"{w} * ({inverse(t)}) AS {n}" for w, t, n in zip(C.WHITE, (f"({fy} + a / 500)", f"{fy}", f"({fy} - b / 200)"), "uvw"))
    channel = lambda row: " + ".join(f"({m}) * {n}" for m, n in zip(row, "uvw"))
    rgb = ", ".join(f"{channel(row)} AS {n}" for row, n in zip(C.TO_RGB, ("l1", "l2", "l3")))
    byte = lambda c: f"least(greatest(floor(255 * CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow(greatest({c}, 1e-12), 1 / 2.4::DOUBLE) - 0.055 END + 0.5), 0), 255)"
    text = " || ".join(f"lpad(lower(hex(CAST({byte(n)} AS BIGINT))), 2, '0')" for n in ("l1", "l2", "l3"))
    return f"SELECT path, '#' || {text} AS color FROM (SELECT path, {rgb} FROM (SELECT path, {xyz} FROM (SELECT path, cos(radians(hue)) * 48 AS a, sin(radians(hue)) * 48 AS b FROM ({hues}))))"


@query(_rgb_sql(HUES))
def module_colors(spark, sf_dir):
    from gridloom.functions.color import hcl_hex

    return H.module_hues(X.hierarchy(spark, sf_dir)).select(F.array_join("path", ":").alias("path"), hcl_hex(F.col("hue"), F.lit(48.0), F.lit(65.0)).alias("color"))


@query(with_("h", "SELECT id FROM h WHERE path[1] = 2"))
def leaves_under(spark, sf_dir):
    return H.leaves_under(X.hierarchy(spark, sf_dir), [2])


@query(with_(TREE, "SELECT DISTINCT array_to_string(prefix, ':') AS path FROM pre WHERE id % 10 = 3", "hr"))
def selection_holders(spark, sf_dir):
    r = X.hierarchy(spark, sf_dir, ragged=True)
    return H.selection_holders(r, r.filter("id % 10 = 3").select("id")).select(F.array_join("path", ":").alias("path"))


@query(with_("hr", "SELECT id FROM hr WHERE id % 10 = 3 OR path[1] = 3", "hr"))
def ancestor_selected(spark, sf_dir):
    r = X.hierarchy(spark, sf_dir, ragged=True)
    return H.ancestor_selected(r, r.filter("id % 10 = 3").select("id"), spark.createDataFrame([([3],)], "path array<bigint>"))


@query(with_("hr", "SELECT id, array_to_string(path[1:len(path) - 1], ':') AS module FROM hr", "hr"))
def enclosing_modules(spark, sf_dir):
    return H.enclosing_modules(X.hierarchy(spark, sf_dir, ragged=True)).select("id", F.array_join("module", ":").alias("module"))


@query(
    with_(
        "hr",
        """, k AS (SELECT path[1:len(path) - 1] AS up, count(*) AS c FROM hr GROUP BY ALL), sub AS (SELECT path[1:len(path) - 2] AS up, count(DISTINCT path[1:len(path) - 1]) AS c FROM hr WHERE len(path) = 3 GROUP BY ALL),
a AS (SELECT k.c AS w, least(k.c + coalesce(sub.c, 0), 4095) AS n FROM k LEFT JOIN sub USING (up)), g AS (SELECT n, sum(w) AS w FROM a GROUP BY n), c AS (SELECT n, sum(w) OVER (ORDER BY n) AS acc, sum(w) OVER () AS t FROM g)
SELECT CAST(min(n) AS BIGINT) AS leaf_branching FROM c WHERE 2 * acc >= t""",
        "hr",
    )
)
def leaf_branching(spark, sf_dir):
    return H.leaf_branching(X.hierarchy(spark, sf_dir, ragged=True)).select(F.col("leaf_branching").cast("long"))


POSITIONS = with_(
    "hr p pre",
    """, n AS (SELECT prefix, k, count(*) AS n, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pre JOIN p USING (id) GROUP BY ALL),
l AS (SELECT path[1:len(path) - 1] AS up, x, y FROM hr JOIN p USING (id)),
box AS (SELECT *, sqrt(greatest(cx - x0, x1 - cx) ** 2 + greatest(cy - y0, y1 - cy) ** 2) AS corner FROM n),
e2 AS (SELECT b.prefix, b.k, b.n, b.cx, b.cy, least(b.corner, max(sqrt((l.x - b.cx) ** 2 + (l.y - b.cy) ** 2))) AS extent FROM box b JOIN l ON l.up = b.prefix WHERE b.k = 2 GROUP BY ALL, b.corner),
e1 AS (SELECT b.prefix, b.k, b.n, b.cx, b.cy, least(b.corner, greatest(coalesce((SELECT max(sqrt((l.x - b.cx) ** 2 + (l.y - b.cy) ** 2)) FROM l WHERE l.up = b.prefix), 0), coalesce((SELECT max(sqrt((c.cx - b.cx) ** 2 + (c.cy - b.cy) ** 2) + c.extent) FROM e2 c WHERE c.prefix[1:1] = b.prefix), 0))) AS extent FROM box b WHERE b.k = 1),
e0 AS (SELECT b.prefix, b.k, b.n, b.cx, b.cy, least(b.corner, (SELECT max(sqrt((c.cx - b.cx) ** 2 + (c.cy - b.cy) ** 2) + c.extent) FROM e1 c)) AS extent FROM box b WHERE b.k = 0)
SELECT array_to_string(prefix, ':') AS path, n AS leaves, round(cx, 4) AS cx, round(cy, 4) AS cy, round(extent, 4) AS extent FROM (SELECT * FROM e2 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e0)""",
    "hr",
)


@query(POSITIONS.replace("GROUP BY ALL, b.corner", "GROUP BY b.prefix, b.k, b.n, b.cx, b.cy, b.corner"))
def lod_positions(spark, sf_dir):
    out = R.positions(X.hierarchy(spark, sf_dir, ragged=True), X.points(spark, sf_dir))
    return out.select(F.array_join("path", ":").alias("path"), "leaves", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "extent")])


@query(with_("hr p pre", "SELECT array_to_string(prefix, ':') AS path, round(sqrt(sum(radius * radius)), 6) AS radius, CAST(sum(CAST(round(importance * 100) AS BIGINT)) AS BIGINT) AS weight FROM pre JOIN p USING (id) GROUP BY prefix", "hr"))
def lod_style(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", "radius", F.round(F.col("importance") * 100).cast("long").alias("weight"))
    return R.style(X.hierarchy(spark, sf_dir, ragged=True), p).select(F.array_join("path", ":").alias("path"), F.round("radius", 6).alias("radius"), "weight")


@query(with_("hr pre", "SELECT array_to_string(prefix, ':') AS path, count(*) AS leaves FROM pre GROUP BY prefix", "hr"))
def leaf_counts(spark, sf_dir):
    return R.leaf_counts(X.hierarchy(spark, sf_dir, ragged=True)).select(F.array_join("path", ":").alias("path"), "leaves")


@query(with_("hr p pre", "SELECT array_to_string(prefix, ':') AS path, CAST(sum(CASE WHEN importance > 0 THEN CAST(round(importance * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS weight FROM pre JOIN p USING (id) GROUP BY prefix", "hr"))
def subtree_weights(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.round(F.col("importance") * 100).cast("long").alias("size"))
    return R.subtree_weights(X.hierarchy(spark, sf_dir, ragged=True), p).select(F.array_join("path", ":").alias("path"), "weight")


@query(with_("h pre p", ", s AS (SELECT prefix, k, CAST(sum(CAST(round(importance * 100) AS BIGINT)) AS BIGINT) AS v FROM pre JOIN p USING (id) GROUP BY ALL) SELECT array_to_string(prefix, ':') AS path, CASE WHEN k = 1 THEN CAST(prefix[1] * 1000 AS BIGINT) ELSE v END AS border FROM s"))
def border_override(spark, sf_dir):
    records = X.hierarchy(spark, sf_dir)
    p = X.points(spark, sf_dir).select("id", F.round(F.col("importance") * 100).cast("long").alias("border"))
    own = H.closure(records).filter("depth = 1").select(F.col("prefix").alias("path"), (F.element_at("prefix", 1) * 1000).alias("given")).distinct()
    return R.border_values(records, p, own).select(F.array_join("path", ":").alias("path"), "border")


@query(with_("hr p pre", ", d AS (SELECT prefix, count(*) AS n, sum(x) AS sx, sum(CASE WHEN id % 7 = 0 THEN 10.0 ELSE 0 END) AS dx FROM pre JOIN p USING (id) GROUP BY prefix) SELECT array_to_string(prefix, ':') AS path, round(sx / n + dx / n, 4) AS cx FROM d", "hr"))
def moved_leaves(spark, sf_dir):
    r, p = X.hierarchy(spark, sf_dir, ragged=True), X.points(spark, sf_dir)
    moved = p.filter("id % 7 = 0").select("id", (F.col("x") + 10).alias("x"), "y")
    return R.update_positions(r, R.positions(r, p), p, moved).select(F.array_join("path", ":").alias("path"), F.round("cx", 4).alias("cx"))


SUPER = with_(
    "hr g2",
    """, e AS (SELECT a.path AS pu, b.path AS pv, weight AS w FROM g2 JOIN hr a ON a.id = source JOIN hr b ON b.id = target WHERE source <> target),
c AS (SELECT *, len(pu) AS du, len(pv) AS dv, CASE WHEN pu[1] <> pv[1] THEN 0 WHEN pu[2] <> pv[2] THEN 1 ELSE 2 END AS lca FROM e),
lv AS (SELECT pu[1:d] AS s, pv[1:d] AS t, w FROM (SELECT *, unnest(range(lca + 1, least(du, dv) + 1)) AS d FROM c)),
up AS (SELECT pu[1:d] AS s, pv AS t, w FROM (SELECT *, unnest(range(dv + 1, du + 1)) AS d FROM c WHERE du > dv) UNION ALL SELECT pu, pv[1:d], w FROM (SELECT *, unnest(range(du + 1, dv + 1)) AS d FROM c WHERE dv > du))
SELECT array_to_string(s, ':') AS source, array_to_string(t, ':') AS target, CAST(sum(w) AS BIGINT) AS flow FROM (SELECT * FROM lv UNION ALL SELECT * FROM up) GROUP BY s, t""",
)


@query(SUPER)
def super_edges(spark, sf_dir):
    out = L.super_edges(X.hierarchy(spark, sf_dir, ragged=True), X.g2(spark, sf_dir))
    return out.select(F.array_join("source", ":").alias("source"), F.array_join("target", ":").alias("target"), "flow")


def _links(spark, sf_dir):
    """Module links: the transitions between nations, and from nations to regions."""
    paths = X.hierarchy(spark, sf_dir)
    e = X.g2(spark, sf_dir)
    at = lambda c: paths.select(F.col("id").alias(c), F.slice("path", 1, 2).alias("p_" + c))
    m = e.join(at("source"), "source").join(at("target"), "target")
    dst = F.when(F.col("edge_id") % 5 == 0, F.slice("p_target", 1, 1)).otherwise(F.col("p_target"))
    return m.select(F.col("p_source").alias("src"), dst.alias("dst"), F.col("weight").alias("flow"))


LINKS = ", m AS (SELECT a.path[1:2] AS src, CASE WHEN edge_id % 5 = 0 THEN b.path[1:1] ELSE b.path[1:2] END AS dst, weight AS flow FROM g2 JOIN h a ON a.id = source JOIN h b ON b.id = target)"


@query(with_("h g2", LINKS + " SELECT array_to_string(src, ':') AS source, array_to_string(dst, ':') AS target, CAST(sum(flow) AS BIGINT) AS flow FROM m WHERE src[1:len(dst)] <> dst AND dst[1:len(src)] <> src GROUP BY src, dst"))
def module_link_rows(spark, sf_dir):
    return L.module_link_rows(_links(spark, sf_dir)).select(F.array_join("source", ":").alias("source"), F.array_join("target", ":").alias("target"), "flow")


@query(with_("h pre tree g2", LINKS + ", q AS (SELECT DISTINCT dst AS path FROM m UNION SELECT path FROM h WHERE id % 9 = 0) SELECT array_to_string(q.path, ':') AS path, coalesce(t.node, h.id) AS node FROM q LEFT JOIN tree t ON t.path = q.path LEFT JOIN h ON h.path = q.path"))
def link_path_resolve(spark, sf_dir):
    r = X.hierarchy(spark, sf_dir)
    asked = _links(spark, sf_dir).select(F.col("dst").alias("path")).union(r.filter("id % 9 = 0").select("path")).distinct()
    return L.resolve_paths(asked, r, H.module_tree(r)).select(F.array_join("path", ":").alias("path"), "node")


@query(with_("hr", "SELECT id, CASE WHEN path[1] IN (2, 4) THEN CAST(path[1] AS VARCHAR) WHEN len(path) = 3 AND path[2] % 2 = 0 THEN path[1] || ':' || path[2] ELSE '' END AS present FROM hr WHERE NOT (path[1] IN (2, 4) AND len(path) = 3 AND path[2] % 2 = 0) UNION ALL SELECT id, path[1] || ':' || path[2] FROM hr WHERE path[1] IN (2, 4) AND len(path) = 3 AND path[2] % 2 = 0"))
def nearest_present_ancestor(spark, sf_dir):
    r = X.hierarchy(spark, sf_dir, ragged=True)
    modules = H.closure(r).select(F.col("prefix").alias("path")).distinct()
    present = modules.filter((F.size("path") == 0) | (F.size("path") == 1) & F.coalesce(F.try_element_at("path", F.lit(1)), F.lit(0)).isin(2, 4) | (F.size("path") == 2) & (F.coalesce(F.try_element_at("path", F.lit(2)), F.lit(1)) % 2 == 0))
    return L.nearest_present(r, present).select("id", F.array_join("present", ":").alias("present"))


@query(with_("hr", "SELECT id, CASE len(path) WHEN 1 THEN CAST(path[1] AS VARCHAR) ELSE array_to_string(path[1:greatest(1, least(2, len(path) - 1))], ':') END AS key FROM hr"))
def module_key_at(spark, sf_dir):
    return X.hierarchy(spark, sf_dir, ragged=True).select("id", H.path_key("path", 2).alias("key"))
