"""Glyph tables, labels, versors and SVG text at their edges: nulls, NaN, ties, empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import labels as B
from gridloom.functions import versor as Q
from gridloom.operators import declutter as D
from gridloom.operators import glyphs as Y
from gridloom.operators import styles
from gridloom.operators import view as V
from gridloom.sources import svg

VIEW = V.View(k=1.0, x=0.0, y=0.0, width=100.0, height=100.0)


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, radius double")


def test_metrics_that_a_graph_lacks_raise(spark):
    nodes = spark.createDataFrame([(1, 2)], "id long, degree long")
    with pytest.raises(ValueError, match="no flow"):
        Y.node_radius(nodes, {"by": "flow", "scale": lambda v: v})
    with pytest.raises(ValueError, match="no flow"):
        styles.metric(nodes, "flow")


def test_importance_follows_the_size_by_default(spark):
    nodes = spark.createDataFrame([(1, 4)], "id long, degree long")
    row = nodes.select(Y.importance(nodes, None, {"by": "degree", "scale": F.sqrt}).alias("a"), Y.importance(nodes, None, lambda d: d).alias("b"), Y.importance(nodes, "order").alias("c")).first()
    assert tuple(row) == (4.0, 1.0, 1.0)


def test_share_borders_without_flow_draw_nothing(spark):
    rows = [(1, 10.0, 5.0, 10.0), (2, 10.0, 5.0, 0.0), (3, 10.0, None, 10.0), (4, 10.0, 20.0, 10.0)]
    nodes = spark.createDataFrame([(*r, "#ffffff") for r in rows], "id long, radius double, exit double, flow double, fill string")
    got = {r["id"]: r["border_width"] for r in Y.flow_border(nodes, F.col("exit"), share=True).collect()}
    assert got[1] == pytest.approx(10 - 10 * math.sqrt(0.5)) and got[2] is None and got[3] is None and got[4] == 10
    assert Y.flow_border(nodes, None).filter("border_width is not null").count() == 0


def test_pick_takes_the_last_in_paint_order(spark):
    rows = [(0, [1], False, 50.0, 50.0, 90.0, 5), (1, [1, 1], True, 50.0, 50.0, 3.0, 1), (2, [2], False, float("nan"), 50.0, 90.0, 5)]
    f = spark.createDataFrame(rows, "pos long, path array<long>, is_leaf boolean, cx double, cy double, radius double, count long")
    assert Y.pick_frontier(f, 51, 50, VIEW).first()["path"] == [1, 1]
    assert Y.pick_frontier(f, 70, 50, VIEW).first()["path"] == [1]
    assert Y.pick_frontier(f, 70, 50, VIEW, largest=10.0).first()["path"] is None
    assert Y.pick_frontier(f.limit(0), 70, 50, VIEW).first()["path"] is None


def test_circles_cap_aggregates_of_several_leaves_only(spark):
    rows = [([1], False, 0.0, 0.0, 90.0, 5), ([2], False, 0.0, 0.0, 90.0, 1), ([3, 1], True, 0.0, 0.0, 90.0, 1)]
    f = spark.createDataFrame(rows, "path array<long>, is_leaf boolean, cx double, cy double, radius double, count long")
    got = {tuple(r["path"]): (r["r"], r["fill"]) for r in Y.frontier_circles(f, "leaf", "agg", 40.0).collect()}
    assert got == {(1,): (40.0, "agg"), (2,): (90.0, "leaf"), (3, 1): (90.0, "leaf")}
    assert [tuple(r["path"]) for r in Y.frontier_halos(f, 3, 2).collect()] == [(1,)]


def test_grid_candidates_equal_the_scan(spark):
    import random

    r = random.Random(2)
    rows = [(i, r.uniform(-200, 200), r.uniform(-200, 200), 1.0) for i in range(500)] + [(500, float("nan"), 1.0, 1.0), (501, 0.0, 100.0, 1.0)]
    p = points(spark, rows)
    for view in (VIEW, V.View(0.1, 0, 0, 100, 100), V.View(1, 5000, 0, 100, 100)):
        grid, cell = Y.candidate_grid(p)
        got = [x["id"] for x in Y.candidates(grid, cell, view).collect()]
        assert got == sorted(x["id"] for x in V.in_view(p, view).collect())
    for few in (rows[:1], [(1, 5.0, 5.0, 1.0), (2, 5.0, 5.0, 1.0)], []):
        grid, cell = Y.candidate_grid(points(spark, few))
        assert Y.candidates(grid, cell, VIEW).count() == V.in_view(points(spark, few), VIEW).count()


def test_rotated_labels_that_only_cross_in_their_bounds_are_both_kept(spark):
    cols = "id long, x double, y double, width double, height double, priority double, rotation double"
    a = math.pi / 4
    rows = [(1, 30.0, 30.0, 40.0, 4.0, 3.0, a), (2, 40.0, 25.0, 40.0, 4.0, 2.0, a), (3, 31.0, 31.0, 40.0, 4.0, 1.0, None)]
    labels = spark.createDataFrame(rows, cols)
    assert sorted(r["id"] for r in D.cull_labels(labels, 100, 100).collect()) == [1, 2]
    plain = labels.drop("rotation")
    assert sorted(r["id"] for r in D.cull_labels(plain.filter("id < 3"), 100, 100).collect()) == [1, 2]
    assert [r["id"] for r in D.cull_labels(labels.withColumns({"x": 26.0 + 4 * F.col("id"), "y": F.lit(30.0)}).filter("id < 3"), 100, 100).collect()] == [1]


def test_upside_down_labels_turn_and_swap_sides(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", B.rendered(F.lit(math.pi), F.lit("start"), F.lit(True)))]).first()
    assert row["a"] == pytest.approx(2 * math.pi) and row["b"] == "end"
    quad = spark.range(1).select(B.corners(F.lit(1.0), F.lit(2.0), F.lit(10.0), F.lit(4.0), F.lit(None).cast("double"), F.lit("middle"), F.lit("middle"), F.lit(False)).alias("q")).first()["q"]
    assert [(p["x"], p["y"]) for p in quad] == [(-4.0, 0.0), (6.0, 0.0), (6.0, 4.0), (-4.0, 4.0)]


def test_text_is_measured_in_utf16_units(spark):
    w, h = B.measure(F.lit("a😀"), F.lit("bold 20px/1.5 serif"))
    assert tuple(spark.range(1).select(w, h).first()) == (33, 25)
    assert spark.range(1).select(B.font_px(F.lit("serif"))).first()[0] == 12.0


def test_versors_turn_and_come_back(spark):
    angles = (20.0, -35.0, 50.0)
    q = Q.from_angles(*map(F.lit, angles))
    assert tuple(spark.range(1).select(*Q.to_angles(q)).first()) == pytest.approx(angles)
    same = Q.direction(F.lit(10.0), F.lit(20.0))
    assert tuple(spark.range(1).select(*Q.turn(same, same)).first()) == (1.0, 0.0, 0.0, 0.0)


def test_fit_of_one_point_and_of_none(spark):
    one = spark.createDataFrame([(10.0, 20.0)], "lon double, lat double")
    p = Q.fit_projection(one, "equirectangular", 100, 50)
    x, y = one.select(*p.forward(F.col("lon"), F.col("lat"))).first()
    assert (x, y) == pytest.approx((50.0, 25.0))
    assert Q.fit_projection(one.limit(0), "equirectangular", 100, 50).scale == 1.0


def test_pins_and_updates(spark):
    before = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 1.0, 1.0)], "id long, x double, y double, vx double, vy double")
    after = before.withColumns({"x": F.col("x") + 1, "y": F.col("y") + 1})
    got = {r["id"]: (r["x"], r["vx"]) for r in Y.hold_pinned(after, before, spark.createDataFrame([(2,), (2,), (9,)], "id long")).collect()}
    assert got == {1: (1.0, 1.0), 2: (5.0, 0.0)}
    nodes = spark.createDataFrame([(1, 0.5, [1]), (2, 0.25, [2])], "id long, flow double, path array<long>")
    new = Y.live_update(nodes, spark.createDataFrame([(1, 0.75)], "id long, flow double"))
    assert {r["id"]: (r["flow"], r["path"]) for r in new.collect()} == {1: (0.75, [1]), 2: (0.25, [2])}


def test_svg_documents_escape_skip_and_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a<b&c"), (0, None)], "ord long, text string")
    text = svg.label(F.lit(1.5), F.lit(-0.0), F.col("text"), F.lit("left"), F.lit(None).cast("string"), F.lit("red"), F.lit(math.pi / 2))
    lines = svg.document(VIEW, [rows.select("ord", svg.path(svg.path_d(F.array(F.array(F.lit(1.0), F.lit(2.0))))).alias("value"))], labels=rows.select("ord", text.alias("value")))
    got = [r["value"] for r in lines.orderBy("part", "ord").collect()]
    assert got[0].startswith("<svg ") and got[-1] == "</svg>" and len(got) == 5  # a path of one point has no line
    assert got[3] == '<text x="1.5" y="0" text-anchor="start" dominant-baseline="central" transform="rotate(90 1.5 0)" style="font:12px sans-serif" fill="red">a&lt;b&amp;c</text>'
    svg.write_document(lines, str(tmp_path / "out"))
    assert sum(1 for f in sorted((tmp_path / "out").glob("part-*")) for _ in open(f)) == 5


def test_anchored_glyphs_stand_together(spark):
    rows = [(1, 0, 10.0, 10.0), (2, 1, 10.0, 10.0), (3, 2, 12.0, 10.0), (4, 3, 90.0, 90.0), (5, 4, None, None)]
    g = spark.createDataFrame(rows, "id long, ord long, ax double, ay double")
    assert sorted(r["id"] for r in Y.declutter_anchored(g, VIEW, 20.0).collect()) == [1, 2, 4, 5]
    assert Y.declutter_anchored(g, VIEW, 0.0).count() == 5
