import math

import pytest

from gridloom.sources import network_text as T
from gridloom.sources import tables as S


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos long, line string")


def test_edge_list(spark):
    text = "# head\n\n a b 2\nb\tc\n a d 0x10\nd d x extra\n"
    edges, nodes = T.parse_edge_list(lines(spark, text))
    names = {r["id"]: r["label"] for r in nodes.collect()}
    assert names == {0: "a", 1: "b", 2: "c", 3: "d"}
    rows = sorted(tuple(r) for r in edges.select("edge_id", "source", "target", "weight").collect())
    assert rows[:3] == [(0, 0, 1, 2.0), (1, 1, 2, 1.0), (2, 0, 3, 16.0)]
    assert rows[3][:3] == (3, 3, 3) and math.isnan(rows[3][3])
    assert nodes.filter("ext_id is not null").count() == 0


def test_plain_ids(spark):
    _, nodes = T.parse_edge_list(lines(spark, "5 7\n7 4294967295"))
    assert {r["ext_id"] for r in nodes.collect()} == {5, 7, 4294967295}
    _, nodes = T.parse_edge_list(lines(spark, "5 07"))
    assert nodes.filter("ext_id is not null").count() == 0


def test_one_column_names_its_line(spark):
    with pytest.raises(Exception, match="line 2"):
        T.parse_edge_list(lines(spark, "1 2\n3"))[0].collect()


def test_pajek_arcs(spark):
    text = '*Vertices 3\n1 "Alpha" 0.1 0.2\n2 "Beta" 0.3 0.4\n3 "Gamma" 0.5 0.6\n*Arcs\n1 2 2.0\n2 3\n'
    edges, nodes, directed = T.parse_pajek(lines(spark, text))
    assert directed
    assert [r["label"] for r in nodes.orderBy("id").collect()] == ["Alpha", "Beta", "Gamma"]
    assert [(r["source"], r["target"], r["weight"]) for r in edges.orderBy("edge_id").collect()] == [(0, 1, 2.0), (1, 2, 1.0)]
    assert nodes.filter("id = 1").first()["x"] == 0.3


def test_pajek_edges_comments_case_and_lists(spark):
    edges, nodes, directed = T.parse_pajek(lines(spark, "% c\n*vertices 2\n1 a\n2 b\n*EDGES\n1 2 3.5"))
    assert not directed and edges.first()["weight"] == 3.5
    edges, _, _ = T.parse_pajek(lines(spark, "*Edgeslist\n1 2 3"))
    assert [(r["source"], r["target"]) for r in edges.orderBy("edge_id").collect()] == [(0, 1), (0, 2)]
    edges, nodes, directed = T.parse_pajek(lines(spark, "*Arcs\n1 3\n3 2"))
    assert directed and [r["label"] for r in nodes.orderBy("id").collect()] == ["1", "2", "3"]
    assert [(r["source"], r["target"]) for r in edges.orderBy("edge_id").collect()] == [(0, 2), (2, 1)]
    edges, nodes, _ = T.parse_pajek(lines(spark, ""))
    assert edges.count() == 0 and nodes.count() == 0


def test_reads_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1 2\n# x\n2 3 4\n")
    edges, _, directed = T.parse_network(T.read_lines(spark, str(tmp_path / "g.txt")), "g.txt")
    assert edges.count() == 2 and not directed
    S.register_network_source(spark)
    rows = spark.read.format("network").load(str(tmp_path / "g.txt")).collect()
    assert sorted((r["line"], r["source"], r["target"], r["weight"]) for r in rows) == [(1, "1", "2", 1.0), (3, "2", "3", 4.0)]


def test_geojson(spark):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":1},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":null,"geometry":{"type":"GeometryCollection","geometries":[{"type":"MultiPoint","coordinates":[[3,4],[5,6]]},{"type":"Sphere"}]}}]}'
    f = S.geojson_features(spark.createDataFrame([(text,)], "value string"))
    assert sorted(r["geometry_type"] for r in f.collect()) == ["MultiPoint", "Point", "Sphere"]
    assert sorted((r["lon"], r["lat"]) for r in S.geojson_points(f).collect()) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]


def test_svg(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0, 3.0, "#fff")], "ord long, x double, y double, r double, fill string")
    text = "\n".join(r["value"] for r in S.svg_circles(rows, 10, 20).orderBy("ord").collect())
    assert text.startswith("<svg") and '<circle cx="1.000"' in text and text.endswith("</svg>")
