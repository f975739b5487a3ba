import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import frontier as R
from gridloom.operators import layout as L
from gridloom.operators import springs as M
from gridloom.operators import view as V

from test_hierarchy import ragged, records


def test_frontier_and_culled_tops_cover_every_leaf_once_and_keep_all_flow(spark):
    rng = random.Random(2)
    paths = ragged(5, 40)
    rec = records(spark, paths)
    cut = []

    def walk(prefix):
        kids = {tuple(p[: len(prefix) + 1]) for p in paths if tuple(p[: len(prefix)]) == prefix and len(p) > len(prefix)}
        for k in kids:
            leaf = any(tuple(p) == k for p in paths)
            if leaf or rng.random() < 0.4:
                if rng.random() < 0.7:  # the rest is out of view
                    cut.append((list(k), leaf))
            else:
                walk(k)

    walk(())
    frontier = spark.createDataFrame(cut, "path array<bigint>, is_leaf boolean")
    tops = R.culled_tops(rec, frontier)
    nodes = frontier.select("path").union(tops)
    per = Counter(r["id"] for r in R.leaf_cover(rec, nodes).collect())
    assert set(per) == set(range(len(paths))) and set(per.values()) == {1}
    links = [(i, rng.randrange(len(paths)), rng.randrange(len(paths)), rng.randint(1, 5)) for i in range(120)]
    cover = {r["id"]: tuple(r["cover"]) for r in R.leaf_cover(rec, nodes).collect()}
    shown = {tuple(p): leaf for p, leaf in cut}
    want = Counter()
    for _, s, t, w in links:
        a, b = cover[s], cover[t]
        if a != b and (a in shown or b in shown) and not ((a in shown and shown[a]) and (b in shown and shown[b])):
            want[a, b] += w
    e = spark.createDataFrame(links, "edge_id long, source long, target long, weight long")
    got = {(tuple(r["source"]), tuple(r["target"])): r["flow"] for r in R.frontier_links(rec, e, frontier).collect()}
    assert got == dict(want)


def test_ancestors_do_not_hide_each_other(spark):
    rows = [(0, [1], 5.0, 5.0, 3.0, 9.0, False), (1, [1, 1], 5.0, 6.0, 1.0, 5.0, True), (2, [2, 1], 5.0, 5.5, 1.0, 4.0, True)]
    df = spark.createDataFrame(rows, "id long, path array<bigint>, x double, y double, radius double, weight double, is_leaf boolean")
    assert sorted(r["id"] for r in R.frontier_declutter(df, V.View(1, 0, 0, 10, 10), 1.0).collect()) == [0, 1]


def test_both_view_prefers_states(spark):
    s = spark.createDataFrame([(4, 5.0, 5.0, 1.0)], "id long, x double, y double, radius double")
    p = spark.createDataFrame([(9, 5.0, 5.0, 4.0)], s.schema)
    view = V.View(1, 0, 0, 10, 10)
    assert R.pick_both(s, p, 5, 5, view).first()["kind"] == "state"
    assert tuple(R.pick_both(s, p, 8, 5, view).first()) == ("physical", 9)
    assert R.region_both(s, p, (0, 0, 9, 9), view).count() == 2


def test_packed_states_do_not_overlap(spark):
    rows = [(k % 3, k, 1.0 + k % 4) for k in range(30)]
    out = L.pack_states(spark.createDataFrame(rows, "physical long, state long, radius double")).collect()
    assert len(out) == 30
    for a in out:
        assert np.hypot(a["dx"], a["dy"]) + a["r"] <= a["outer"] + 1e-9
        for b in out:
            if a["physical"] == b["physical"] and a["state"] < b["state"]:
                assert np.hypot(a["dx"] - b["dx"], a["dy"] - b["dy"]) >= a["r"] + b["r"]


def test_springs_pull_modules_together_and_keep_momentum(spark):
    rec = records(spark, [[1, 1], [1, 2], [2, 1], [2, 2]])
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 2.0), (2, 10.0, 0.0), (3, 10.0, 2.0)], "id long, x double, y double")
    links = spark.createDataFrame([([1], [2], 4)], "src array<bigint>, dst array<bigint>, flow long")
    s = M.module_springs(links)
    assert s.first()["weight"] == 1.0
    f = {r["id"]: (r["ax"], r["ay"]) for r in M.module_forces(rec, pts, s, 0.1).collect()}
    assert abs(f[0][0] - 0.5) < 1e-9 and abs(sum(v[0] for v in f.values())) < 1e-9 and f[0] == f[1]
    assert M.spring_gain(rec, s).agg(F.sum("gain")).first()[0] == 2.0
    w = {tuple(r["path"]): r for r in M.warm_start(rec, pts).collect()}
    assert (w[1,]["cx"], w[1,]["cy"], w[1,]["spread"]) == (0.0, 1.0, 1.0)


def test_strategy_and_table_function(spark):
    from gridloom.functions import draw

    draw.register(spark)
    assert spark.sql("SELECT * FROM regular_polygon(0D, 0D, 1D, 3)").count() == 4
    pts = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.5, 1.0, 1.0)], "id long, x double, y double, radius double")
    s = draw.Decluttered(1.0)
    view = V.View(1, 0, 0, 10, 10)
    assert [r["id"] for r in s.select(pts, view).collect()] == [0] and s.pick(pts, 2.4, 1.0, view).first()["id"] is None
    assert s.pick_region(pts, (0, 0, 9, 9), view).count() == 1
