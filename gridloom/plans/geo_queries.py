"""Geometry, projection, colour and style queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.functions import geometry as G
from gridloom.functions.projection import Projection, visible
from gridloom.operators import scene
from gridloom.operators import styles as S
from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import with_

GEO = "geo AS (SELECT c_custkey AS id, CAST((c_custkey * 137) % 360 - 180 AS DOUBLE) AS lon, CAST((c_custkey * 71) % 180 - 90 AS DOUBLE) AS lat FROM customer)"


def _geo(spark, sf_dir):
    key = F.col("c_custkey")
    return X.table(spark, sf_dir, "customer").select(key.alias("id"), ((key * 137) % 360 - 180).cast("double").alias("lon"), ((key * 71) % 180 - 90).cast("double").alias("lat"))


@query(f"WITH {GEO} SELECT id FROM geo WHERE 2 * asin(sqrt(least(1.0, sin(radians(lat - 20) / 2) ** 2 + cos(radians(lat)) * cos(radians(20)) * sin(radians(lon - 10) / 2) ** 2))) <= radians(60) + 1e-6")
def visible_points(spark, sf_dir):
    return _geo(spark, sf_dir).filter(visible(F.col("lon"), F.col("lat"), 10, 20, 60)).select("id")


@query(f"WITH {GEO} SELECT id, round(400 + 100 * radians(lon), 6) AS x, round(300 - 100 * radians(lat), 6) AS y FROM geo")
def project_equirectangular(spark, sf_dir):
    x, y = Projection("equirectangular", 100, 400, 300).forward(F.col("lon"), F.col("lat"))
    return _geo(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"WITH {GEO} SELECT id, round(400 + 100 * cos(radians(lat)) * sin(radians(lon - 10)), 6) AS x, round(300 - 100 * (cos(radians(20)) * sin(radians(lat)) - sin(radians(20)) * cos(radians(lat)) * cos(radians(lon - 10))), 6) AS y FROM geo")
def project_orthographic(spark, sf_dir):
    x, y = Projection("orthographic", 100, 400, 300, 10, 20).forward(F.col("lon"), F.col("lat"))
    return _geo(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"WITH {GEO} SELECT id, round(lon, 4) AS lon, round(greatest(least(lat, 85), -85), 4) AS lat FROM geo")
def invert_mercator(spark, sf_dir):
    """There and back; latitudes past 85 degrees are drawn at 85."""
    m = Projection("mercator", 100, 400, 300)
    g = _geo(spark, sf_dir)
    x, y = m.forward(F.col("lon"), F.col("lat"))
    lon, lat = m.inverse(F.col("x"), F.col("y"))
    return g.select("id", x.alias("x"), y.alias("y")).select("id", (F.round(lon, 4) + 0.0).alias("lon"), (F.round(lat, 4) + 0.0).alias("lat"))


def _rings(spark, sf_dir):
    """A quadrilateral per part."""
    p = X.table(spark, sf_dir, "part")
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 17 + 1).cast("double")
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(w, F.lit(0.0)), F.array(w + 1, h), F.array(F.lit(0.0), h))
    return p.select(F.col("p_partkey").alias("id"), ring.alias("ring"))


@query("SELECT p_partkey AS id, round((p_size * 2 + 1) * (p_partkey % 17 + 1) / 2.0, 6) AS area FROM part")
def signed_area(spark, sf_dir):
    return _rings(spark, sf_dir).select("id", F.round(G.signed_area(F.col("ring")), 6).alias("area"))


@query("SELECT p_partkey AS id FROM part WHERE 4.5 < p_partkey % 17 + 1 AND 10 < p_size + 4.5 / (p_partkey % 17 + 1)")
def point_in_ring(spark, sf_dir):
    return _rings(spark, sf_dir).filter(G.point_in_ring(F.lit(10.0), F.lit(4.5), F.col("ring"))).select("id")


@query("SELECT p_partkey AS id, round(sqrt((p_size - 20) ** 2 + greatest(3 - (p_partkey % 17 + 1), 0) ** 2), 6) AS d FROM part")
def distance_to_path(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    path = F.array(F.array(F.lit(20.0), F.lit(0.0)), F.array(F.lit(20.0), (F.col("p_partkey") % 17 + 1).cast("double")))
    return p.select(F.col("p_partkey").alias("id"), F.round(G.distance_to_path(F.col("p_size").cast("double"), F.lit(3.0), path), 6).alias("d"))


@query("SELECT max(p_partkey) AS ord, max(p_partkey) AS id FROM part WHERE p_partkey % 5 <> 0 AND (CASE p_partkey % 3 WHEN 0 THEN 4.5 < p_partkey % 17 + 1 AND 10 < p_size + 4.5 / (p_partkey % 17 + 1) ELSE (p_size - 10.0) ** 2 + (p_partkey % 17 + 1 - 4.5) ** 2 <= 9 END)")
def pick_drawable(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    c = F.array(F.array(F.col("p_size").cast("double"), (F.col("id") % 17 + 1).cast("double")))
    d = _rings(spark, sf_dir).join(p, "id").select(F.col("id").alias("ord"), "id", F.when(F.col("id") % 3 == 0, "fill").otherwise("circle").alias("kind"), F.when(F.col("id") % 3 == 0, F.col("ring")).otherwise(c).alias("points"), F.lit(0.0).alias("half_width"), F.lit(3.0).alias("radius"), (F.col("id") % 5 == 0).alias("hidden"))
    return scene.pick_drawable(d, 10.0, 4.5)


@query("WITH o AS (SELECT o_custkey AS id, arg_max('#' || lpad(hex(o_orderkey % 4096), 3, '0'), o_orderkey) AS f, arg_max(CAST(o_orderkey % 5 AS DOUBLE) / 4, o_orderkey) AS p FROM orders GROUP BY 1) SELECT c_custkey AS id, coalesce(lower(f), '#888') AS fill, CAST(floor((100 + c_custkey % 100) * coalesce(p, 1) + 0.5) AS INTEGER) AS alpha FROM customer LEFT JOIN o ON o.id = c_custkey")
def style_override(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lower(F.concat(F.lit("#"), F.lpad(F.hex(F.col("o_orderkey") % 4096), 3, "0"))).alias("fill"), ((F.col("o_orderkey") % 5) / 4).alias("opacity"), F.col("o_orderkey").alias("version"))
    rows = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("#888").alias("fill"), (100 + F.col("c_custkey") % 100).cast("double").alias("alpha"))
    return S.apply_overrides(rows, o)


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 200 ELSE 50 END AS INTEGER) AS alpha FROM customer")
def dim_others(spark, sf_dir):
    rows = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(200).alias("alpha"))
    picked = X.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return S.dim_others(rows, picked, 0.25)


@query(with_("p", "SELECT id, round(radius - radius * sqrt(1 - least(greatest(y / 10007, 0), 1)), 6) AS width FROM p"))
def share_border(spark, sf_dir):
    return X.points(spark, sf_dir).select("id", F.round(S.share_border(F.col("radius"), F.col("y"), F.lit(10007.0)), 6).alias("width"))


@query("SELECT p_partkey AS id, CAST((p_partkey + 1) & 255 AS BIGINT) AS r, CAST(((p_partkey + 1) >> 8) & 255 AS BIGINT) AS g, CAST(((p_partkey + 1) >> 16) & 255 AS BIGINT) AS b FROM part")
def pick_colors(spark, sf_dir):
    r, g, b = C.pick_color(F.col("p_partkey"))
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT p_partkey AS id, CAST(p_partkey % 256 AS INTEGER) AS r, CAST(p_partkey * 7 % 256 AS INTEGER) AS g, CAST(p_partkey * 31 % 256 AS INTEGER) AS b FROM part")
def color_round_trip(spark, sf_dir):
    k = F.col("p_partkey")
    h, c, l = C.rgb_to_hcl(*[(k * m % 256).cast("double") for m in (1, 7, 31)])  # noqa: E741
    hcl = X.table(spark, sf_dir, "part").select(k.alias("id"), h.alias("h"), c.alias("c"), l.alias("l"))
    r, g, b = C.hcl_to_rgb(F.col("h"), F.col("c"), F.col("l"))
    return hcl.select("id", C.byte(r).alias("r"), C.byte(g).alias("g"), C.byte(b).alias("b"))


@query("SELECT p_partkey AS id, CASE WHEN length(p_name) <= 10 THEN p_name ELSE rtrim(substr(p_name, 1, 9)) || '…' END AS label FROM part")
def trim_labels(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.trim_to_width(F.col("p_name"), F.lit(60.0), 6.0).alias("label"))
