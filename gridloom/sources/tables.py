"""In-memory and GeoJSON sources, and a ``network`` data source for ``spark.read``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_from_columns(rows: DataFrame, source: str, target: str, weight: str | None = None, order: list[str] | None = None) -> DataFrame:
    """(edge_id, source, target, weight) of a table's columns; weight 1 if there is none."""
    from gridloom.plans.storage import dense_index

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    picked = rows.withColumns({"__s": F.col(source).cast("long"), "__t": F.col(target).cast("long"), "__w": w})
    return dense_index(picked, order or ["__s", "__t", "__w"], "edge_id").select("edge_id", F.col("__s").alias("source"), F.col("__t").alias("target"), F.col("__w").alias("weight"))


GEOMETRY = "type string, coordinates string, geometries array<string>"


def geojson_features(texts: DataFrame, column: str = "value") -> DataFrame:
    """(ord, geometry_type, coordinates, properties): features of GeoJSON texts; coordinates and properties are JSON.

    FeatureCollection, Feature, bare geometries, GeometryCollection and Sphere are flattened to one row a geometry.
    """
    get = lambda c, path: F.get_json_object(c, path)
    root = texts.select(F.monotonically_increasing_id().alias("doc"), F.col(column).alias("j"))
    items = root.select("doc", F.posexplode(F.when(get("j", "$.type") == "FeatureCollection", F.from_json(get("j", "$.features"), "array<string>")).otherwise(F.array("j"))).alias("ord", "f"))
    geometry = F.when(get("f", "$.type") == "Feature", get("f", "$.geometry")).otherwise(F.col("f"))
    one = items.select("doc", "ord", get("f", "$.properties").alias("properties"), geometry.alias("g"))
    flat = one.select("doc", "ord", "properties", F.explode(F.when(get("g", "$.type") == "GeometryCollection", F.from_json(get("g", "$.geometries"), "array<string>")).otherwise(F.array("g"))).alias("g"))
    return flat.filter("g is not null").select("doc", "ord", get("g", "$.type").alias("geometry_type"), get("g", "$.coordinates").alias("coordinates"), "properties")


def geojson_points(features: DataFrame) -> DataFrame:
    """(doc, ord, lon, lat) of Point and MultiPoint geometries."""
    single = F.from_json("coordinates", "array<double>")
    many = F.from_json("coordinates", "array<array<double>>")
    pts = F.when(F.col("geometry_type") == "Point", F.array(single)).when(F.col("geometry_type") == "MultiPoint", many)
    return features.select("doc", "ord", F.explode(pts).alias("p")).select("doc", "ord", F.element_at("p", 1).alias("lon"), F.element_at("p", 2).alias("lat"))


def geojson_paths(features: DataFrame) -> DataFrame:
    """(doc, ord, part, ring, closed, points) of lines and polygons: a row a line or ring, points as [lon, lat].

    Parts number the members of a multi-geometry; a polygon's ring 0 is its outline, others are holes. Empty
    coordinates give no row, points have none.
    """
    parse = lambda depth: F.from_json("coordinates", "array<" * depth + "double" + ">" * depth)
    kind = F.col("geometry_type")
    members = (
        F.when(kind == "LineString", F.array(F.array(parse(2))))
        .when(kind == "MultiLineString", F.transform(parse(3), lambda line: F.array(line)))
        .when(kind == "Polygon", F.array(parse(3)))
        .when(kind == "MultiPolygon", parse(4))
    )
    parts = features.select("doc", "ord", kind.endswith("Polygon").alias("closed"), F.posexplode(members).alias("part", "rings"))
    rows = parts.select("doc", "ord", "part", "closed", F.posexplode("rings").alias("ring", "points"))
    return rows.filter(F.size("points") > 0).select("doc", "ord", "part", "ring", "closed", "points")


def register_network_source(spark: SparkSession) -> None:
    """``spark.read.format("network").load(path)``: (line, source, target, weight) of edge-list text, streamed from
    each file by its own task, labels as text."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class NetworkReader(DataSourceReader):
        def __init__(self, options):
            self.path = options.get("path")

        def partitions(self):
            import glob

            return [InputPartition(p) for p in sorted(glob.glob(self.path)) or [self.path]]

        def read(self, partition):
            with open(partition.value, encoding="utf-8") as f:
                for no, line in enumerate(f, 1):
                    t = line.split()
                    if not t or t[0].startswith("#"):
                        continue
                    if len(t) < 2:
                        raise ValueError(f'line {no}: expected at least two columns, got "{t[0]}"')
                    yield no, t[0], t[1], float(t[2]) if len(t) > 2 else 1.0

    class Network(DataSource):
        @classmethod
        def name(cls):
            return "network"

        def schema(self):
            return "line long, source string, target string, weight double"

        def reader(self, schema):
            return NetworkReader(self.options)

    spark.dataSource.register(Network)


def write_geojson_points(rows: DataFrame, path: str) -> None:
    """A text sink: one GeoJSON feature a line from (lon, lat, other columns as properties)."""
    rest = [c for c in rows.columns if c not in ("lon", "lat")]
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties")))
    rows.select(feature.alias("value")).write.mode("overwrite").text(path)


def svg_circles(rows: DataFrame, width: int, height: int) -> DataFrame:
    """(ord, value): an SVG document's lines from (ord, x, y, r, fill)."""
    head = rows.sparkSession.createDataFrame([(-1, f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">')], "ord long, value string")
    tail = rows.sparkSession.createDataFrame([((1 << 62), "</svg>")], "ord long, value string")
    body = rows.select(F.col("ord").cast("long").alias("ord"), F.format_string('<circle cx="%.3f" cy="%.3f" r="%.3f" fill="%s"/>', "x", "y", "r", "fill").alias("value"))
    return head.unionByName(body).unionByName(tail)


def to_geojson(geometry: dict) -> str:
    return json.dumps(geometry, separators=(",", ":"))
