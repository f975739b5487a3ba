"""View, spatial and greedy queries over P, P2, H and G1."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import morton as M
from gridloom.operators import declutter as D
from gridloom.operators import hierarchy as H
from gridloom.operators import rollup as R
from gridloom.operators import spatial as S
from gridloom.operators import view as V
from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import with_
from gridloom.plans.hierarchy_queries import POSITIONS

VIEW = V.View(k=0.05, x=400, y=0, width=800, height=600)
CLOSE = V.View(k=0.2, x=100, y=-200, width=800, height=600)


@query(with_("p", "SELECT id, x BETWEEN (0 - 400) / 0.05 AND (800 - 400) / 0.05 AND y BETWEEN 0 AND 600 / 0.05 AS shown, round(least(x + 8000, 8000 - x, y, 12000 - y), 6) AS inside FROM p"))
def visible_rect(spark, sf_dir):
    """Of every point, whether the view's rectangle holds it and how far it is from its nearest side."""
    x0, x1, y0, y1 = VIEW.world()
    x, y = F.col("x"), F.col("y")
    return X.points(spark, sf_dir).select("id", V.within(x, y, (x0, x1, y0, y1)).alias("shown"), F.round(F.least(x - x0, x1 - x, y - y0, y1 - y), 6).alias("inside"))


@query(with_("p", "SELECT id FROM p WHERE x BETWEEN -500 AND 3500 AND y BETWEEN 1000 AND 4000"))
def in_view(spark, sf_dir):
    return V.in_view(X.points(spark, sf_dir), CLOSE).select("id")


@query(with_("p", "SELECT max(id) AS id FROM p WHERE (x * 0.2 + 100 - 400) ** 2 + (y * 0.2 - 200 - 300) ** 2 <= (radius * 4) ** 2"))
def pick_nodes(spark, sf_dir):
    return V.pick_nodes(X.points(spark, sf_dir).withColumn("radius", F.col("radius") * 4), 400, 300, CLOSE)


@query(with_("p", "SELECT id FROM p WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 1500 AND 2500"))
def region_nodes(spark, sf_dir):
    return V.region_nodes(X.points(spark, sf_dir), (100, 100, 300, 300), CLOSE)


RINGS = ", r AS (SELECT c_custkey AS ring, c_acctbal AS cx, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS cy, CAST(500 + c_custkey % 300 AS DOUBLE) AS r, c_custkey % 4 AS alpha, c_custkey % 3 AS depth FROM customer)"


@query("WITH " + RINGS[2:] + ", h AS (SELECT ring, depth FROM r WHERE sqrt((cx - 1500) ** 2 + (cy - 2500) ** 2) BETWEEN r - 20 - 5 AND r + 5 AND alpha > 0) SELECT arg_max(ring, depth * 1000000 + ring) AS ring FROM h")
def pick_ring(spark, sf_dir):
    c, key = X.table(spark, sf_dir, "customer"), F.col("c_custkey")
    rings = c.select(key.alias("ring"), F.col("c_acctbal").alias("cx"), ((key * 7919) % 10007).cast("double").alias("cy"), (500 + key % 300).cast("double").alias("r"), F.lit(20.0).alias("w"), (key % 4).alias("alpha"), (key % 3).alias("depth"), key.alias("pos"))
    return V.pick_ring(rings, 400, 300, CLOSE, min_hit=6.0)


CUT = POSITIONS[: POSITIONS.rindex("SELECT array_to_string")].replace("GROUP BY ALL, b.corner", "GROUP BY b.prefix, b.k, b.n, b.cx, b.cy, b.corner") + """, m AS (SELECT prefix, k, cx, cy, extent, (cx + extent < -8000 OR cx - extent > 8000 OR cy + extent < 0 OR cy - extent > 12000) AS culled, 2 * extent * 0.05 >= 560 AS expands FROM (SELECT * FROM e2 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e0)),
stop AS (SELECT prefix FROM m WHERE culled OR NOT expands),
leaf AS (SELECT path FROM hr JOIN p USING (id) WHERE x BETWEEN -8000 AND 8000 AND y BETWEEN 0 AND 12000)
SELECT array_to_string(path, ':') AS path, true AS is_leaf FROM leaf WHERE NOT list_has_any([path[1:0], path[1:1], path[1:2]][1:len(path)], coalesce((SELECT list(prefix) FROM stop), []))
UNION ALL SELECT array_to_string(prefix, ':'), false FROM m WHERE NOT culled AND NOT expands AND (k = 0 OR NOT list_has_any([prefix[1:0], prefix[1:1]][1:k], coalesce((SELECT list(prefix) FROM stop), [])))"""


def _cut(spark, sf_dir, expand_px):
    r, p = X.hierarchy(spark, sf_dir, ragged=True), X.points(spark, sf_dir)
    return V.cut(r, R.positions(r, p), p, VIEW, expand_px)


@query(CUT)
def lod_cut(spark, sf_dir):
    return _cut(spark, sf_dir, 560.0).select(F.array_join("path", ":").alias("path"), "is_leaf")


@query(CUT[: CUT.index(", m AS")] + " SELECT array_to_string(prefix, ':') AS path FROM (SELECT * FROM e2 UNION ALL SELECT * FROM e1) WHERE 2 * extent * 0.05 >= 500 AND sqrt(greatest(-8000 - cx, cx - 8000, 0) ** 2 + greatest(0 - cy, cy - 12000, 0) ** 2) <= extent")
def module_boundaries(spark, sf_dir):
    r, p = X.hierarchy(spark, sf_dir, ragged=True), X.points(spark, sf_dir)
    return V.expanded_boundaries(R.positions(r, p), VIEW, 500.0).select(F.array_join("path", ":").alias("path"))


@query(with_("h", "SELECT array_to_string(path[1:2], ':') AS path, round(greatest(48, least(48 * sqrt(count(*) / 2.0), 300)), 6) AS px FROM h GROUP BY 1"))
def default_expand_px(spark, sf_dir):
    """The threshold of each nation's module as its own tree: its branching is its number of customers."""
    n = X.hierarchy(spark, sf_dir).groupBy(F.slice("path", 1, 2).alias("path")).agg(F.count("*").alias("n"))
    px = spark.createDataFrame([(b, V.default_expand_px(b, 800, 600)) for (b,) in n.select("n").distinct().collect()], "n long, px double")  # a row a size of a nation
    return n.join(px, "n").select(F.array_join("path", ":").alias("path"), F.round("px", 6).alias("px"))


@query(with_("p", "SELECT id, importance FROM p ORDER BY importance DESC, id LIMIT 25"))
def topk_labels(spark, sf_dir):
    return V.top_labels(X.points(spark, sf_dir), "importance", 25).select("id", "importance")


@query(with_("p", "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p"))
def layout_box(spark, sf_dir):
    return S.layout_box(X.points(spark, sf_dir))


@query(
    with_(
        "p",
        """, b AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM p), h AS (SELECT least(floor((x - lo) / ((hi - lo) / 256)), 255) AS bin, count(*) AS c, min(x) AS a, max(x) AS z, any_value(least(64, CAST(floor(0.005 * n) AS INT))) AS allow, any_value(n) AS n FROM p, b GROUP BY 1),
w AS (SELECT *, sum(c) OVER (ORDER BY bin) AS below FROM h) SELECT min(a) AS lo, max(z) AS hi FROM w WHERE below > allow AND n - below + c > allow""",
    )
)
def trimmed_box(spark, sf_dir):
    return S.trimmed_range(X.points(spark, sf_dir), "x")


@query(with_("p", ", b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), k AS (SELECT *, 510 / greatest(x1 - x0, y1 - y0) AS k FROM b) SELECT round(k, 9) AS k, round(400 - k * (x0 + x1) / 2, 6) AS x, round(300 - k * (y0 + y1) / 2, 6) AS y FROM k"))
def fit_transform(spark, sf_dir):
    return V.fit_transform(S.layout_box(X.points(spark, sf_dir)), 800, 600).select(F.round("k", 9).alias("k"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


BOX = (-4096.0, 0.0, 16384.0)
CODES = ", q AS (SELECT id, x, y, CAST(floor((x + 4096) / 16384 * 65536) AS BIGINT) AS qx, CAST(floor(y / 16384 * 65536) AS BIGINT) AS qy FROM p), c AS (SELECT id, CAST(list_sum(list_transform(range(16), lambda b: (((qx >> b) & 1) << (2 * b)) + (((qy >> b) & 1) << (2 * b + 1)))) AS BIGINT) AS code FROM q)"


def _coded(spark, sf_dir):
    return M.quantized(X.points(spark, sf_dir), BOX)


@query(with_("p", CODES + " SELECT id, code FROM c"))
def morton_codes(spark, sf_dir):
    return _coded(spark, sf_dir).select("id", "code")


def _common(a, b):
    return f"CASE WHEN xor({a}, {b}) = 0 THEN 16 ELSE 16 - CAST(floor((length(ltrim(bin(xor({a}, {b})), '0')) + 1) / 2) AS INT) END"


CELLS = CODES + f""", t AS (SELECT code, unnest(range(0, 17)) AS l FROM c), g AS (SELECT l, code - code % CAST(4 ** (16 - l) AS BIGINT) AS prefix, count(*) AS n, min(code) AS lo, max(code) AS hi FROM t GROUP BY ALL),
gg AS (SELECT *, {_common('lo', 'hi')} AS cl FROM g),
cells AS (SELECT a.cl AS level, a.lo - a.lo % CAST(4 ** (16 - a.cl) AS BIGINT) AS code, a.n FROM gg a LEFT JOIN gg u ON u.l = a.l - 1 AND u.prefix = a.prefix - a.prefix % CAST(4 ** (17 - a.l) AS BIGINT) WHERE a.l = 0 OR (u.n > 8 AND u.cl = a.l - 1 AND a.l - 1 < 16))"""


@query(with_("p", CELLS + " SELECT CAST(level AS INTEGER) AS level, code, n FROM cells"))
def morton_tree(spark, sf_dir):
    return S.morton_cells(_coded(spark, sf_dir)).select("level", "code", "n")


@query(with_("p", CELLS + ", a AS (SELECT DISTINCT CAST(10 AS INTEGER) AS level, code - code % 4096 AS code FROM c WHERE id % 5 = 0), f AS (SELECT a.level, a.code, c.level AS found_level, c.code AS found_code FROM a JOIN cells c ON c.level <= a.level AND a.code - a.code % CAST(4 ** (16 - c.level) AS BIGINT) = c.code) SELECT level, code, CAST(max(found_level) AS INTEGER) AS found_level, arg_max(found_code, found_level) AS found_code FROM f GROUP BY ALL"))
def find_cell(spark, sf_dir):
    coded = _coded(spark, sf_dir)
    asked = coded.filter("id % 5 = 0").select(F.lit(10).alias("level"), M.prefix(F.col("code"), 10).alias("code")).distinct()
    return S.find_cells(asked, S.morton_cells(coded))


COVER = CODES + ", k AS (SELECT id, code - code % CAST(4 ** 13 AS BIGINT) AS cell FROM c)"


@query(with_("p g2", COVER + ", e AS (SELECT a.cell AS cs, b.cell AS ct, sum(weight) AS w FROM g2 JOIN k a ON a.id = source JOIN k b ON b.id = target WHERE a.cell <> b.cell GROUP BY ALL) SELECT least(cs, ct) AS a, greatest(cs, ct) AS b, CAST(sum(CASE WHEN cs < ct THEN w ELSE 0 END) AS BIGINT) AS flow_ab, CAST(sum(CASE WHEN cs > ct THEN w ELSE 0 END) AS BIGINT) AS flow_ba FROM e GROUP BY 1, 2"))
def lazy_super_edges(spark, sf_dir):
    coded = _coded(spark, sf_dir)
    frontier = coded.select(F.lit(3).alias("level"), M.prefix(F.col("code"), 3).alias("code")).distinct()
    cover = S.covers(coded, frontier).select("id", F.col("cell_code").alias("cell"))
    return S.lazy_super_edges(X.g2(spark, sf_dir), cover)


#: Greedy thinning in SQL: one row a step, the kept boxes so far in a list.
GREEDY = ", n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM s WHERE {on}), g AS (SELECT 0 AS k, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) AS kept UNION ALL SELECT k + 1, CASE WHEN len(list_filter(kept, lambda o: {hit})) > 0 THEN kept ELSE list_append(kept, {{'id': n.id, 'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h}}) END FROM g JOIN n ON n.rank = g.k + 1) SELECT unnest(kept).id AS id FROM (SELECT arg_max(kept, k) AS kept FROM g)"
DISCS = "(o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y) < {s} * {s} * (o.w + n.w) * (o.w + n.w)"


def _greedy(body, order, on, hit):
    return with_("p", body + GREEDY.format(order=order, on=on, hit=hit)).replace("WITH ", "WITH RECURSIVE ", 1)


ON_SCREEN = "x BETWEEN 0 AND 800 AND y BETWEEN 0 AND 600"
ON_NEAR = ", s AS (SELECT id, x * 0.2 + 100 AS x, y * 0.2 - 200 AS y, radius AS w, 0.0 AS h, importance FROM p)"


DECLUTTERED = _greedy(ON_NEAR, "importance DESC, id", ON_SCREEN, DISCS.format(s=2.0)) + f" UNION ALL SELECT id FROM s WHERE NOT ({ON_SCREEN})"


@query(DECLUTTERED)
def declutter(spark, sf_dir):
    return D.declutter(X.points(spark, sf_dir), CLOSE, spacing=2.0, order=-F.col("importance"))


@query(
    _greedy(ON_NEAR, "importance DESC, id", ON_SCREEN, DISCS.format(s=6.0)).replace(" SELECT unnest(kept).id AS id", ", k AS (SELECT unnest(kept).id AS id", 1)
    + f" UNION ALL SELECT id FROM s WHERE NOT ({ON_SCREEN})), d AS (SELECT n.id, o.id AS winner, sqrt((o.x - n.x) ** 2 + (o.y - n.y) ** 2) AS d FROM s n JOIN s o ON {DISCS.format(s=6.0)} WHERE n.id NOT IN (SELECT id FROM k) AND o.id IN (SELECT id FROM k)) SELECT id, winner FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, winner) = 1"
)
def declutter_winners(spark, sf_dir):
    p = X.points(spark, sf_dir)
    kept = D.declutter(p, CLOSE, spacing=6.0, order=-F.col("importance"))
    return D.winners(p, kept, CLOSE, spacing=6.0)


BOXES = ", s AS (SELECT id, x * 0.2 + 100 AS x, y * 0.2 - 200 AS y, CAST(20 + id % 30 AS DOUBLE) / 2 + 2 AS w, 8.0 AS h, importance FROM p WHERE x BETWEEN -500 AND 3500 AND y BETWEEN 1000 AND 4000)"


@query(_greedy(BOXES, "importance DESC, id", "x + w > 0 AND x - w < 800 AND y + h > 0 AND y - h < 600", "abs(o.x - n.x) < o.w + n.w AND abs(o.y - n.y) < o.h + n.h"))
def label_cull(spark, sf_dir):
    p = V.in_view(X.points(spark, sf_dir), CLOSE)
    labels = p.select("id", (F.col("x") * CLOSE.k + CLOSE.x).alias("x"), (F.col("y") * CLOSE.k + CLOSE.y).alias("y"), (20 + F.col("id") % 30).cast("double").alias("width"), F.lit(12.0).alias("height"), F.col("importance").alias("priority"))
    return D.cull_labels(labels, CLOSE.width, CLOSE.height, padding=2.0)


@query("WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS r, CAST(l_extendedprice AS DOUBLE) / 100 AS d FROM lineitem) SELECT id, round(CASE WHEN d >= 2 * greatest(r, 10) THEN 1 / d WHEN d < r + 10 THEN -1 ELSE 0.5 / (d - greatest(r, 10)) END, 9) AS world, round((greatest(r, 0.5) + 10) / d, 9) AS screen FROM c")
def clear_zoom(spark, sf_dir):
    """Of every row, the zoom at which a circle of its quantity clears one of radius 10; -1 for never."""
    rows = X.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("r"), (F.col("l_extendedprice").cast("double") / 100).alias("d"))
    z = V.clear_zoom(F.col("d"), F.col("r"), F.lit(10.0), False)
    return rows.select("id", F.round(F.when(z == float("inf"), -1.0).otherwise(z), 9).alias("world"), F.round(V.clear_zoom(F.col("d"), F.col("r"), F.lit(10.0), True), 9).alias("screen"))


@query(with_("h p", ", a AS (SELECT path[1:2] AS m, id, x, y, 2 * radius AS r FROM h JOIN p USING (id)) SELECT array_to_string(a.m, ':') AS module, round(max((a.r + b.r) / sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS clear_zoom FROM a JOIN a b ON a.m = b.m AND a.id < b.id GROUP BY a.m"))
def lod_crowding(spark, sf_dir):
    return V.crowding(X.hierarchy(spark, sf_dir), X.points(spark, sf_dir)).select(F.array_join("module", ":").alias("module"), F.round("clear_zoom", 6).alias("clear_zoom"))


@query(with_("h", "SELECT array_to_string(path[1:1], ':') AS path, count(*) AS n FROM h GROUP BY 1"))
def selection_by_path(spark, sf_dir):
    return X.hierarchy(spark, sf_dir).groupBy(H.path_key("path", 1).alias("path")).agg(F.count("*").alias("n"))
