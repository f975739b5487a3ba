import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import iterate as I
from gridloom.operators import layout as L


def graph(spark, n=30, m=120, seed=2):
    r = random.Random(seed)
    rows = [(i, r.randrange(n - 1), r.randrange(n), r.randint(1, 5)) for i in range(m)]
    return rows, spark.createDataFrame(rows, "edge_id long, source long, target long, weight long")


def test_flow_equals_the_dense_iteration(spark):
    n = 5
    rows = [(0, 0, 1, 1), (1, 1, 2, 2), (2, 2, 0, 1), (3, 0, 3, 1), (4, 3, 4, 1), (5, 1, 4, 3), (6, 2, 2, 1)]  # 4 dangles
    e = spark.createDataFrame(rows, "edge_id long, source long, target long, weight long")
    a = np.zeros((n, n))
    for _, s, t, w in rows:
        a[s, t] += w
    out, v = a.sum(1), a.sum(0) / a.sum()
    p = np.full(n, 1 / n)
    for _ in range(500):
        p = 0.85 * sum(p[s] * a[s] / out[s] for s in range(n) if out[s]) + (0.15 + 0.85 * p[out == 0].sum()) * v
    nodes, links = I.random_walk_flow(spark.range(n), e, tolerance=1e-9, steps=40)
    got = np.array([r["flow"] for r in nodes.orderBy("id").collect()])
    assert np.abs(got - p / p.sum()).max() < 1e-6 and abs(got.sum() - 1) < 1e-9
    assert abs(links.agg(F.sum("flow")).first()[0] - (1 - p[4])) < 1e-6
    assert [r["flow"] for r in I.random_walk_flow(spark.range(4), e.limit(0))[0].collect()] == [0.25] * 4


def test_matching_follows_the_order(spark):
    rows, e = graph(spark)
    adj = {}
    for i, s, t, w in rows:
        if s != t:
            adj.setdefault(s, []).append((t, w))
            adj.setdefault(t, []).append((s, w))
    group, k = {}, 0
    for v in range(30):
        if v in group:
            continue
        free = [x for x in adj.get(v, []) if x[0] not in group]
        taken = [x for x in adj.get(v, []) if x[0] in group]
        if free:
            best = max(free, key=lambda x: x[1])
            group[v] = group[best[0]] = k
            k += 1
        elif taken:
            group[v] = group[max(taken, key=lambda x: x[1])[0]]
        else:
            group[v] = k
            k += 1
    assert {r["id"]: r["grp"] for r in I.heavy_edge_matching(spark.range(30), e).collect()} == group


def test_matching_takes_one_row_a_pair_and_any_ordered_edge_id(spark):
    rows, e = graph(spark, 30, 400, 5)
    numbers = {r["id"]: r["grp"] for r in I.heavy_edge_matching(spark.range(31), e).collect()}  # node 30 has no link
    structs = e.withColumn("edge_id", F.struct(F.lit("a").alias("x"), F.col("edge_id").alias("y")))
    assert {r["id"]: r["grp"] for r in I.heavy_edge_matching(spark.range(31), structs).collect()} == numbers
    assert I.link_pairs(e).count() == len({(s, t) for _, s, t, _ in rows})  # what the kernel reads doesn't grow with parallel links
    a, b = I.coarse_levels(spark.range(31), e), I.coarse_levels(spark.range(31), structs)
    assert len(a) == len(b) and all(sorted(map(tuple, x[0].collect())) == sorted(map(tuple, y[0].collect())) for x, y in zip(a, b))


def test_levels_keep_all_mass(spark):
    _, e = graph(spark)
    nodes = spark.range(30)
    levels = I.coarse_levels(nodes, e)
    assert levels and all(m.agg(F.sum("mass")).first()[0] == 30 for m in I.coarse_masses(levels, nodes))


def test_local_matching_pairs_at_most_two(spark):
    _, e = graph(spark)
    assert I.local_matching(spark.range(30), e).groupBy("grp").count().agg(F.max("count")).first()[0] == 2


def test_pyramid_is_close_to_exact(spark):
    r = random.Random(3)
    rows = [(i, r.uniform(0, 1000), r.uniform(0, 1000), 0.0, 0.0) for i in range(400)]
    s = spark.createDataFrame(rows, "id long, x double, y double, vx double, vy double")
    e = spark.createDataFrame([], "source long, target long, weight long")
    exact = np.array([(x["vx"], x["vy"]) for x in I.force_tick(s, e, levels=0, centering=0.0001).orderBy("id").collect()])
    near = np.array([(x["vx"], x["vy"]) for x in I.force_tick(s, e, levels=3, centering=0.0001).orderBy("id").collect()])
    assert np.abs(exact - near).mean() < 0.05 * np.abs(exact).mean()


def test_nested_discs_lie_inside_their_parents(spark):
    tree = spark.createDataFrame([(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6), (6, None)], "node long, parent long")
    w = spark.createDataFrame([(i, float(i + 1)) for i in range(7)], "node long, weight double")
    links = spark.createDataFrame([(6, 4, 5, 1.0)], "module long, a long, b long, weight double")
    d = {r["node"]: r for r in L.nested_layout(tree, w, links, 50.0).collect()}
    parent = {0: 4, 1: 4, 2: 5, 3: 5, 4: 6, 5: 6}
    for a, b in parent.items():
        assert np.hypot(d[a]["cx"] - d[b]["cx"], d[a]["cy"] - d[b]["cy"]) + d[a]["r"] <= d[b]["r"] * 1.0001
    for a, b in ((0, 1), (2, 3), (4, 5)):
        assert np.hypot(d[a]["cx"] - d[b]["cx"], d[a]["cy"] - d[b]["cy"]) >= 0.9 * (d[a]["r"] + d[b]["r"])
    assert d[1]["r"] > d[0]["r"]


def test_module_sums_equal_all_pairs_and_hold_no_square(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(L, "PAIRS", 64, raising=False)
    g = np.random.default_rng(4)
    x, r = g.uniform(-1, 1, (90, 2)), g.uniform(0.01, 0.2, 90)
    diff = x[:, None] - x[None]
    far = (diff / ((diff**2).sum(-1) + 1e-9)[..., None]).sum(1)
    assert np.allclose(L._repulsion(x), far, rtol=1e-12)
    dist = np.sqrt((diff**2).sum(-1)) + np.eye(90)
    over = np.maximum(0, 1.15 * (r[:, None] + r[None]) - dist) * (1 - np.eye(90))
    share = (r**2)[None] / ((r**2)[:, None] + (r**2)[None])
    assert np.allclose(L._collisions(x, r), (diff / dist[..., None] * (over * share)[..., None] * 0.5).sum(1), rtol=1e-12)
    monkeypatch.undo()
    tracemalloc.start()
    L.solve_module(np.ones(2500), [(i, i + 1, 1.0) for i in range(2499)], ticks=2)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # 2500 squared in doubles: 50 MB for each axis of a difference
    tracemalloc.stop()


def test_frames_settle(spark):
    _, e = graph(spark, 12, 20)
    s = L.seed_positions(spark.range(12), 100, 100, 50.0).select("id", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    frames = list(I.force_frames(s, e, ticks=4, every=2))
    assert [t for t, _ in frames] == [2, 4] and frames[-1][1].count() == 12
