import pytest
from pyspark.sql import functions as F

from gridloom.operators import frames as R
from gridloom.operators import validate as V
from gridloom.operators.view import View


def test_checks_name_what_is_wrong(spark):
    nodes = spark.range(3)
    rec = spark.createDataFrame([(0, [1, 1]), (1, [1, 2]), (2, [2, 1])], "id long, path array<bigint>")
    V.check_records(nodes, rec)
    with pytest.raises(ValueError, match="node 2 has no module record"):
        V.check_records(nodes, rec.filter("id < 2"))
    with pytest.raises(ValueError, match="node 0 has several"):
        V.check_records(nodes, rec.union(rec.limit(1)))
    with pytest.raises(ValueError, match="node 3 is no node"):
        V.check_records(nodes, rec.union(spark.createDataFrame([(3, [1])], rec.schema)))
    V.check_values(nodes, spark.range(3))
    with pytest.raises(ValueError, match="node 2 has no flow"):
        V.check_values(nodes, spark.range(2))
    V.check_links(spark.createDataFrame([([1], [2, 1])], "src array<bigint>, dst array<bigint>"), rec)
    with pytest.raises(ValueError, match="path 9"):
        V.check_links(spark.createDataFrame([([1], [9])], "src array<bigint>, dst array<bigint>"), rec)
    assert not V.draws_links("none") and not V.draws_links(0) and V.draws_links(1.5)


def test_has_layout(spark):
    p = lambda rows: spark.createDataFrame(rows, "x double, y double")
    assert V.has_layout(p([(0.0, 0.0), (0.0, 1.0)])) and not V.has_layout(p([(1.0, 1.0), (1.0, 1.0), (float("nan"), 2.0)])) and not V.has_layout(p([]))


def test_lod_frames_skip_still_frames_and_keep_the_box(spark):
    a = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(49)], "id long, x double, y double")
    b = a.withColumn("x", F.col("x") * 0.9)
    out = list(R.lod_frames([(0, a), (1, a), (2, b)]))
    assert [n for n, _ in out] == [0, 2] and all(c.filter("level = 0 or n = 49").count() >= 1 for _, c in out)


def test_nested_frames_go_down(spark):
    tree = spark.createDataFrame([(0, 2), (1, 2), (2, None)], "node long, parent long")
    discs = tree.select("node", F.lit(1.0).alias("r"))
    assert [(d, x.count()) for d, x in R.nested_frames(discs, tree)] == [(0, 1), (1, 2)]


def test_labels_and_fades(spark):
    a = spark.createDataFrame([(0, 5.0, 5.0, "long label", 1.0), (1, 6.0, 5.0, "x", 2.0), (2, 500.0, 5.0, "off", 9.0), (3, 5.0, 90.0, None, 9.0)], "id long, x double, y double, text string, priority double")
    assert [r["id"] for r in R.place_labels(a, View(1, 0, 0, 100, 100)).collect()] == [1]
    r = spark.range(1).select(R.fade(F.lit(50.0), 100.0, 0.2), R.fade(F.lit(130.0), 100.0, 0.2), R.fade(F.lit(100.0), 100.0, 0.2)).first()
    assert tuple(r) == (1.0, 0.0, 0.5)
