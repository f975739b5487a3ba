"""Queries over text made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.sources import network_text as T
from gridloom.sources import tables as S

LINES_SQL = """WITH t AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 50 = 0 THEN '# a comment' WHEN o_orderkey % 77 = 0 THEN '   ' WHEN o_orderkey % 3 = 0 THEN 'n' || o_custkey || E'\\t' || 'n' || (o_custkey * 7 % 97) ELSE '  n' || o_custkey || ' n' || (o_custkey * 7 % 97) || ' ' || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_orderkey % 9 AS VARCHAR) || '.5' END || ' more' END AS line FROM orders),
r AS (SELECT pos, regexp_split_to_array(trim(replace(line, E'\\t', ' ')), ' +') AS t FROM t WHERE trim(line) <> '' AND trim(line)[1] <> '#'),
e AS (SELECT pos, t[1] AS s, t[2] AS d, CASE WHEN len(t) > 2 THEN coalesce(try_cast(t[3] AS DOUBLE), CAST('nan' AS DOUBLE)) ELSE 1.0 END AS weight FROM r),
n AS (SELECT label, row_number() OVER (ORDER BY min(seq)) - 1 AS id FROM (SELECT s AS label, 2 * pos AS seq FROM e UNION ALL SELECT d, 2 * pos + 1 FROM e) GROUP BY label)
"""


def _lines(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    other = (c * 7 % 97).cast("string")
    weight = F.when(k % 11 == 0, "x").otherwise(F.concat((k % 9).cast("string"), F.lit(".5")))
    line = F.when(k % 50 == 0, "# a comment").when(k % 77 == 0, "   ").when(k % 3 == 0, F.concat(F.lit("n"), c.cast("string"), F.lit("\tn"), other)).otherwise(F.concat(F.lit("  n"), c.cast("string"), F.lit(" n"), other, F.lit(" "), weight, F.lit(" more")))
    return X.table(spark, sf_dir, "orders").select(k.alias("pos"), line.alias("line"))


@query(LINES_SQL + "SELECT row_number() OVER (ORDER BY pos) - 1 AS edge_id, a.id AS source, b.id AS target, CASE WHEN isnan(weight) THEN -1 ELSE weight END AS weight FROM e JOIN n a ON a.label = s JOIN n b ON b.label = d")
def parse_edge_list(spark, sf_dir):
    edges, _ = T.parse_edge_list(_lines(spark, sf_dir))
    return edges.withColumn("weight", F.when(F.isnan("weight"), -1.0).otherwise(F.col("weight")))


@query(LINES_SQL + "SELECT id, label FROM n")
def parse_edge_list_nodes(spark, sf_dir):
    return T.parse_edge_list(_lines(spark, sf_dir))[1].select("id", "label")


PAJEK_SQL = """WITH v AS (SELECT n_nationkey * 3 + 1 AS ext_id, n_name AS label FROM nation WHERE n_nationkey % 4 <> 0),
l AS (SELECT o_orderkey AS k, (o_custkey % 25) * 3 + 1 AS s, (o_custkey * 7 % 29) * 3 + 1 AS d, o_orderkey % 5 AS w FROM orders),
i AS (SELECT ext_id FROM v UNION SELECT s FROM l UNION SELECT d FROM l), n AS (SELECT i.ext_id, row_number() OVER (ORDER BY i.ext_id) - 1 AS id, coalesce(label, CAST(i.ext_id AS VARCHAR)) AS label FROM i LEFT JOIN v USING (ext_id))
"""


def _pajek(spark, sf_dir):
    fixed = spark.createDataFrame([(0, "*Vertices 25"), (100, "% comment"), (101, "*Arcs")], "pos long, line string")
    v = X.table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select((F.col("n_nationkey") + 1).cast("long").alias("pos"), F.format_string(' %d "%s" 0.25 0.75', F.col("n_nationkey") * 3 + 1, "n_name").alias("line"))
    o = X.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 200).alias("pos"), F.format_string("%d %d %d", (F.col("o_custkey") % 25) * 3 + 1, (F.col("o_custkey") * 7 % 29) * 3 + 1, F.col("o_orderkey") % 5).alias("line"))
    return fixed.unionByName(v).unionByName(o)


@query(PAJEK_SQL + "SELECT row_number() OVER (ORDER BY k) - 1 AS edge_id, a.id AS source, b.id AS target, CAST(w AS DOUBLE) AS weight FROM l JOIN n a ON a.ext_id = s JOIN n b ON b.ext_id = d")
def parse_pajek(spark, sf_dir):
    return T.parse_pajek(_pajek(spark, sf_dir))[0]


@query(PAJEK_SQL + "SELECT id, ext_id, label, CASE WHEN label <> CAST(ext_id AS VARCHAR) THEN CAST(0.25 AS DOUBLE) END AS x FROM n")
def parse_pajek_nodes(spark, sf_dir):
    return T.parse_pajek(_pajek(spark, sf_dir))[1].select("id", "ext_id", "label", "x")


@query("SELECT * FROM (VALUES ('a.net', 'pajek'), ('a.csv', 'edges'), ('b', 'pajek'), ('c', 'edges')) t(name, format)")
def detect_format(spark, sf_dir):
    texts = {"a.net": "", "a.csv": "*Vertices", "b": "\n" * 300 + " *Vertices 3", "c": "1 2"}
    return spark.createDataFrame([(k, T.detect_format(v, k)) for k, v in texts.items()], "name string, format string")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS edge_id, o_custkey AS source, o_orderkey % 97 AS target, 1.0::DOUBLE AS weight FROM orders")
def graph_from_columns(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 97).alias("d"))
    return S.graph_from_columns(o, "o_custkey", "d", order=["o_orderkey"])


@query("SELECT CAST(p_partkey AS INTEGER) AS k, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, p_partkey % 3 > 0 AS closed, CAST(p_size + ring AS DOUBLE) AS lon, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 4 END AS INTEGER) AS n FROM part, range(2) a(part), range(2) b(ring) WHERE (p_partkey % 3 = 0 AND part = 0 AND ring = 0) OR (p_partkey % 3 = 1 AND part = 0) OR p_partkey % 3 = 2")
def geojson_paths(spark, sf_dir):
    """A line, a polygon with a hole, or two such polygons for every part."""
    size = F.col("p_size")
    ring = lambda k: F.format_string("[[%d,0],[9,0],[9,9],[%d,0]]", size + k, size + k)
    polygon = F.concat(F.lit("["), ring(0), F.lit(","), ring(1), F.lit("]"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "LineString").when(F.col("p_partkey") % 3 == 1, "Polygon").otherwise("MultiPolygon")
    shape = F.when(F.col("p_partkey") % 3 == 0, F.format_string("[[%d,0],[1,1]]", size)).when(F.col("p_partkey") % 3 == 1, polygon).otherwise(F.concat(F.lit("["), polygon, F.lit(","), polygon, F.lit("]")))
    text = F.concat(F.format_string('{"type":"Feature","properties":{"k":%d},"geometry":{"type":"', "p_partkey"), kind, F.lit('","coordinates":'), shape, F.lit("}}"))
    features = S.geojson_features(X.table(spark, sf_dir, "part").select(text.alias("value")))
    key = features.select("doc", "ord", F.get_json_object("properties", "$.k").cast("int").alias("k"))
    return S.geojson_paths(features).join(key, ["doc", "ord"]).select("k", "part", "ring", "closed", F.col("points")[0][0].alias("lon"), F.size("points").alias("n"))


@query("SELECT CAST(c_custkey AS INTEGER) AS ord, CAST((c_custkey * 137) % 360 - 180 AS DOUBLE) AS lon, CAST((c_custkey * 71) % 180 - 90 AS DOUBLE) AS lat FROM customer")
def geojson_points(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    feature = F.format_string('{"type":"Feature","properties":{"k":%d},"geometry":{"type":"Point","coordinates":[%d,%d]}}', "c_custkey", (F.col("c_custkey") * 137) % 360 - 180, (F.col("c_custkey") * 71) % 180 - 90)
    rows = c.select("c_custkey", feature.alias("value"))
    pts = S.geojson_points(S.geojson_features(rows))
    key = S.geojson_features(rows).select("doc", "ord", F.get_json_object("properties", "$.k").cast("int").alias("k"))
    return pts.join(key, ["doc", "ord"]).select(F.col("k").alias("ord"), "lon", "lat")
