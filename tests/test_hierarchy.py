import random
from collections import Counter

from gridloom.operators import hierarchy as H
from gridloom.operators import links as L
from gridloom.operators import rollup as R
from gridloom.operators import view as V


def records(spark, paths):
    return spark.createDataFrame(list(enumerate(paths)), "id long, path array<bigint>")


def ragged(seed, n):
    """Random paths: no module's path is a node's."""
    r = random.Random(seed)
    modules = [()]
    for _ in range(n // 3):
        m = r.choice(modules)
        if len(m) < 4:
            modules.append((*m, 1000 + len(modules)))
    held = Counter()
    out = []
    for m in modules:
        for _ in range(r.randint(1, 3)):
            held[m] += 1
            out.append(list(m) + [held[m]])
    return out


def test_balanced_tree(spark):
    rec = records(spark, [[1, 1], [1, 2], [2, 1], [2, 2]])
    tree = {tuple(r["path"]): r["node"] for r in H.module_tree(rec).collect()}
    assert tree == {(1,): 4, (2,): 5, (): 6}
    parents = {r["node"]: r["parent"] for r in H.tree_nodes(rec, H.module_tree(rec)).collect()}
    assert parents == {0: 4, 1: 4, 2: 5, 3: 5, 4: 6, 5: 6, 6: None}


def test_ragged_tree_keeps_children_below_parents(spark):
    for seed in (1, 2):
        rec = records(spark, ragged(seed, 30))
        rows = H.tree_nodes(rec, H.module_tree(rec)).collect()
        level = {r["node"]: r["level"] for r in rows}
        assert len(level) == len(rows)
        for r in rows:
            if r["parent"] is not None:
                assert r["node"] < r["parent"] and r["level"] < level[r["parent"]]


def test_super_edges_of_the_balanced_tree(spark):
    rec = records(spark, [[1, 1], [1, 2], [2, 1], [2, 2]])
    e = spark.createDataFrame([(0, 0, 2, 1), (1, 1, 3, 4), (2, 1, 1, 9)], "edge_id long, source long, target long, weight long")
    got = {(tuple(r["source"]), tuple(r["target"])): r["flow"] for r in L.super_edges(rec, e).collect()}
    assert got == {((1, 1), (2, 1)): 1, ((1, 2), (2, 2)): 4, ((1,), (2,)): 5}


def test_super_edges_against_walks_up_ragged_trees(spark):
    paths = ragged(7, 40)
    rng = random.Random(5)
    links = [(rng.randrange(len(paths)), rng.randrange(len(paths)), rng.randint(1, 9)) for _ in range(150)]
    want = Counter()
    for s, t, w in links:
        pu, pv = paths[s], paths[t]
        c = 0
        while c < min(len(pu), len(pv)) and pu[c] == pv[c]:
            c += 1
        if s == t or c in (len(pu), len(pv)):
            continue
        m = min(len(pu), len(pv))
        for d in range(c + 1, m + 1):
            want[tuple(pu[:d]), tuple(pv[:d])] += w
        for d in range(m + 1, len(pu) + 1):
            want[tuple(pu[:d]), tuple(pv)] += w
        for d in range(m + 1, len(pv) + 1):
            want[tuple(pu), tuple(pv[:d])] += w
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(links)], "edge_id long, source long, target long, weight long")
    got = {(tuple(r["source"]), tuple(r["target"])): r["flow"] for r in L.super_edges(records(spark, paths), e).collect()}
    assert got == dict(want)


def test_cut_equals_the_walk_down(spark):
    rng = random.Random(11)
    paths = ragged(3, 60)
    pts = [(i, rng.uniform(0, 100), rng.uniform(0, 100), 1.0) for i in range(len(paths))]
    rec, p = records(spark, paths), spark.createDataFrame(pts, "id long, x double, y double, radius double")
    mod = R.positions(rec, p).persist()
    view = V.View(5.0, 0.0, 0.0, 400.0, 300.0)
    m = {tuple(r["path"]): r for r in mod.collect()}
    x0, x1, y0, y1 = view.world()

    def gone(x, y, e):
        return x + e < x0 or x - e > x1 or y + e < y0 or y - e > y1

    want, kids = set(), {}
    for i, q in enumerate(paths):
        for d in range(len(q)):
            kids.setdefault(tuple(q[:d]), set()).add(tuple(q[: d + 1]))
    leaf = {tuple(q): i for i, q in enumerate(paths)}

    def walk(q):
        if q in leaf:
            if not gone(pts[leaf[q]][1], pts[leaf[q]][2], 0):
                want.add((q, True))
        elif not gone(m[q]["cx"], m[q]["cy"], m[q]["extent"]):
            if 2 * m[q]["extent"] * view.k >= 300:
                for k in kids[q]:
                    walk(k)
            else:
                want.add((q, False))

    walk(())
    got = {(tuple(r["path"]), r["is_leaf"]) for r in V.cut(rec, mod, p, view, 300.0).collect()}
    assert got == want and len({x[1] for x in got}) == 2


def test_extent_covers_all_leaves(spark):
    rng = random.Random(4)
    paths = ragged(9, 40)
    pts = {i: (rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(len(paths))}
    mod = R.positions(records(spark, paths), spark.createDataFrame([(i, *xy) for i, xy in pts.items()], "id long, x double, y double")).collect()
    for r in mod:
        for i, q in enumerate(paths):
            if q[: len(r["path"])] == r["path"] and len(q) > len(r["path"]):
                assert ((pts[i][0] - r["cx"]) ** 2 + (pts[i][1] - r["cy"]) ** 2) ** 0.5 <= r["extent"] + 1e-9


def test_moved_leaves_give_the_exact_centroid(spark):
    rec = records(spark, [[1, 1], [1, 2], [2, 1]])
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 9.0, 9.0)], "id long, x double, y double")
    moved = spark.createDataFrame([(1, 4.0, 2.0)], "id long, x double, y double")
    out = {tuple(r["path"]): r for r in R.update_positions(rec, R.positions(rec, p), p, moved).collect()}
    assert (out[1,]["cx"], out[1,]["cy"]) == (2.0, 1.0) and out[1,]["extent"] >= 5**0.5 - 1e-9
    assert out[2,]["cx"] == 9.0


def test_path_keys(spark):
    rows = spark.createDataFrame([([],), ([7],), ([1, 2],), ([1, 2, 3],)], "path array<bigint>").select(H.path_key("path", 2)).collect()
    assert [r[0] for r in rows] == ["root", "7", "1", "1:2"]


def test_unresolved_link_raises(spark):
    import pytest

    rec = records(spark, [[1, 1], [2, 1]])
    asked = spark.createDataFrame([([3],)], "path array<bigint>")
    with pytest.raises(Exception, match="no module or node"):
        L.resolve_paths(asked, rec, H.module_tree(rec)).collect()


def test_hue_means_are_circular(spark):
    rec = records(spark, [[1, 1], [1, 2]])
    leaves = spark.createDataFrame([(0, 350.0, 10.0, 50.0), (1, 10.0, 10.0, 70.0)], "id long, h double, c double, l double")
    rows = {tuple(r["path"]): r for r in R.hue_means(rec, leaves).collect()}
    assert abs(rows[1,]["h"]) < 1e-6 and rows[1,]["l"] == 60.0
