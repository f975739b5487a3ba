import random

from pyspark.sql import functions as F

from gridloom.functions import morton as M
from gridloom.operators import declutter as D
from gridloom.operators import spatial as S
from gridloom.operators import view as V


def points(spark, n, seed=1, size=100.0):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, size), r.uniform(0, size), r.choice([0.5, 1.0, 3.0]), r.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, radius double, importance double")


def test_declutter_equals_the_greedy_pass(spark):
    for seed in (1, 2):
        rows, df = points(spark, 250, seed)
        rows.append((250, float("nan"), 3.0, 1.0, 9.0))
        rows.append((251, -50.0, 3.0, 100.0, 9.0))
        df = spark.createDataFrame(rows, df.schema)
        view = V.View(1.0, 0.0, 0.0, 100.0, 100.0)
        kept = []
        for i, x, y, r, w in sorted(rows, key=lambda t: (-t[4], t[0])):
            if not (0 <= x <= 100 and 0 <= y <= 100):
                kept.append((i, None))
            elif all(k[1] is None or (k[1] - x) ** 2 + (k[2] - y) ** 2 >= (1.5 * (r + k[3])) ** 2 for k in kept):
                kept.append((i, x, y, r))
        got = {r["id"] for r in D.declutter(df, view, 1.5, -F.col("importance")).collect()}
        assert got == {k[0] for k in kept}


def test_label_culling_equals_the_greedy_pass_and_touching_is_allowed(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(0, 120) * 1.0, r.randrange(0, 80) * 1.0, 20.0, 10.0, float(r.randrange(5))) for i in range(120)]
    kept = []
    for i, x, y, w, h, p in sorted(rows, key=lambda t: (-t[5], t[0])):
        if x + w / 2 > 0 and x - w / 2 < 100 and y + h / 2 > 0 and y - h / 2 < 60 and all(abs(x - a) >= 20 or abs(y - b) >= 10 for _, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(rows, "id long, x double, y double, width double, height double, priority double")
    assert {x["id"] for x in D.cull_labels(df, 100.0, 60.0).collect()} == {k[0] for k in kept}


def test_thinning_compares_with_kept_rows_only(spark, monkeypatch):
    """Crowds are thinned over several blocks, and no table of conflicts is made of them."""
    def refuse(*a, **k):
        raise AssertionError("a table of conflicts grows with the square of a crowd")

    monkeypatch.setattr(D, "near_pairs", refuse)
    monkeypatch.setattr(D.thinned, "__defaults__", (40,))
    view = V.View(1.0, 0.0, 0.0, 100.0, 100.0)
    for order in ("importance", "x"):  # at random, and from one side to the other
        rows, df = points(spark, 700, 6)
        key = {"importance": 4, "x": 1}[order]
        on = []
        for row in sorted(rows, key=lambda t: (t[key], t[0])):
            if all((row[1] - k[1]) ** 2 + (row[2] - k[2]) ** 2 >= (1.5 * (row[3] + k[3])) ** 2 for k in on):
                on.append(row)
        kept = D.declutter(df, view, 1.5, F.col(order))
        assert {r["id"] for r in kept.collect()} == {k[0] for k in on}
        nearest = {}
        for row in set(rows) - set(on):
            d = [(((row[1] - k[1]) ** 2 + (row[2] - k[2]) ** 2) ** 0.5, k[0]) for k in on if (row[1] - k[1]) ** 2 + (row[2] - k[2]) ** 2 < (1.5 * (row[3] + k[3])) ** 2]
            nearest[row[0]] = min(d)[1]
        assert {r["id"]: r["winner"] for r in D.winners(df, kept, view, 1.5).collect()} == nearest


def test_labels_and_frontiers_thin_without_a_table_of_conflicts(spark, monkeypatch):
    from gridloom.operators import frontier as R

    def refuse(*a, **k):
        raise AssertionError("a table of conflicts grows with the square of a crowd")

    monkeypatch.setattr(D, "near_pairs", refuse)
    monkeypatch.setattr(D.thinned, "__defaults__", (40,))
    rows, df = points(spark, 300, 7)
    kept = []
    for row in sorted(rows, key=lambda t: (-t[4], t[0])):
        if all(abs(row[1] - k[1]) >= 8 or abs(row[2] - k[2]) >= 4 for k in kept):
            kept.append(row)
    labels = df.select("id", "x", "y", F.lit(8.0).alias("width"), F.lit(4.0).alias("height"), F.col("importance").alias("priority"))
    assert {r["id"] for r in D.cull_labels(labels, 100.0, 100.0).collect()} == {k[0] for k in kept}
    kept, kin = [], lambda a, b: a == b == 0  # rows 0, 7, 14, ... lie on one path
    path = F.when(F.col("id") % 7 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.col("id").cast("int")))
    for row in sorted(rows, key=lambda t: (-t[4], t[0])):
        if all(kin(row[0] % 7, k[0] % 7) or (row[1] - k[1]) ** 2 + (row[2] - k[2]) ** 2 >= (2.0 * (row[3] + k[3])) ** 2 for k in kept):
            kept.append(row)
    nodes = df.select("id", path.alias("path"), "x", "y", "radius", F.col("importance").alias("weight"), F.lit(True).alias("is_leaf"))
    assert {r["id"] for r in R.frontier_declutter(nodes, V.View(1.0, 0.0, 0.0, 100.0, 100.0), 2.0).collect()} == {k[0] for k in kept}


def test_nan_is_never_in_view(spark):
    df = spark.createDataFrame([(0, float("nan"), 1.0), (1, 1.0, 1.0)], "id long, x double, y double")
    assert [r["id"] for r in V.in_view(df, V.View(1, 0, 0, 10, 10)).collect()] == [1]
    assert S.layout_box(df).first()["x1"] == 1.0


def test_last_match_wins(spark):
    df = spark.createDataFrame([(0, 5.0, 5.0, 3.0), (1, 6.0, 5.0, 3.0), (2, 50.0, 5.0, 3.0)], "id long, x double, y double, radius double")
    view = V.View(1, 0, 0, 100, 100)
    assert V.pick_nodes(df, 5.5, 5.0, view).first()["id"] == 1
    assert V.pick_nodes(df, 30.0, 5.0, view).first()["id"] is None


def test_morton_cells_equal_the_recursive_split(spark):
    rows, df = points(spark, 300, 4)
    df = df.union(df.limit(5)).withColumn("id", F.monotonically_increasing_id())
    coded = M.quantized(df, (0.0, 0.0, 128.0)).persist()
    codes = sorted(r["code"] for r in coded.select("code").collect())

    def level(a, b):
        x = a ^ b
        return 16 if x == 0 else 16 - (x.bit_length() + 1) // 2

    want = set()

    def split(part):
        k = level(part[0], part[-1])
        want.add((k, part[0] - part[0] % 4 ** (16 - k), len(part)))
        if len(part) > 8 and k < 16:
            groups = {}
            for c in part:
                groups.setdefault(c >> (2 * (15 - k)), []).append(c)
            for g in groups.values():
                split(g)

    split(codes)
    got = {(r["level"], r["code"], r["n"]) for r in S.morton_cells(coded).collect()}
    assert got == want
    back = coded.select((M.squeeze(F.col("code")) / 65536 * 128).alias("bx"), "x").collect()
    assert all(abs(r["bx"] - r["x"]) <= 128 / 65536 for r in back)


def test_crowding_equals_all_pairs(spark):
    rows, df = points(spark, 120, 6)
    rec = spark.createDataFrame([(i, [i % 3, i]) for i in range(120)], "id long, path array<bigint>")
    want = {}
    for i in range(120):
        for j in range(i):
            if i % 3 == j % 3:
                d = ((rows[i][1] - rows[j][1]) ** 2 + (rows[i][2] - rows[j][2]) ** 2) ** 0.5
                want[i % 3] = max(want.get(i % 3, 0), (2 * rows[i][3] + 2 * rows[j][3]) / d)
    got = {r["module"][0]: r["clear_zoom"] for r in V.crowding(rec, df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_view_interpolation_ends(spark):
    a, b = V.View(1, 2, 3, 10, 10), V.View(4, 5, 6, 10, 10)
    assert V.interpolate_view(a, b, 0.0) == V.View(1, 2, 3, 10, 10) and V.interpolate_view(a, b, 1.0) == b
