import random

from gridloom.operators import graph as G
from gridloom.operators import states as S


def edges(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id long, source long, target long, weight long")


def test_degree_counts_a_self_link_once_and_isolated_nodes_zero(spark):
    e = edges(spark, [(0, 0, 5), (0, 1, 2), (1, 0, 1)])
    rows = {r["id"]: (r["degree"], r["strength"]) for r in G.degree_strength(spark.range(3), e).collect()}
    assert rows == {0: (3, 8), 1: (2, 3), 2: (0, 0)}


def test_adjacency_holds_a_self_link_twice_in_edge_order(spark):
    rows = G.adjacency(edges(spark, [(0, 1, 1), (0, 0, 2), (2, 0, 3)])).collect()
    assert sorted((r["id"], r["pos"], r["neighbor"], r["weight"]) for r in rows) == [(0, 0, 1, 1), (0, 1, 0, 2), (0, 2, 0, 2), (0, 3, 2, 3), (1, 0, 0, 1), (2, 0, 0, 3)]


def test_reciprocal_takes_the_last_opposite_link(spark):
    rows = G.reciprocal_edges(edges(spark, [(0, 1, 1), (1, 0, 1), (1, 0, 1), (2, 2, 1), (2, 3, 1)])).collect()
    assert {r["edge_id"]: r["reciprocal"] for r in rows} == {0: 2, 1: 0, 2: 0, 3: 3, 4: -1}


def test_state_network(spark):
    states = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "state long, physical long")
    e = edges(spark, [(0, 2, 2), (1, 2, 1), (2, 0, 3), (0, 1, 5)])
    rows = S.physical_network(states, e).collect()
    assert {(r["source"], r["target"]): r["weight"] for r in rows} == {(0, 1): 3, (1, 0): 3, (0, 0): 5}


def test_lump_ranks_skip_taken_branches(spark):
    lumped = spark.createDataFrame([(i, 0, 10 - i) for i in range(5)], "lump long, module long, members long")
    taken = spark.createDataFrame([(0, 1), (0, 3), (0, 4)], "module long, branch long")
    assert [r["rank"] for r in S.lump_ranks(lumped, "members", taken).orderBy("lump").collect()] == [2, 5, 6, 7, 8]


def test_pies_with_no_flow_are_equal_slices_and_near_ties_go_to_the_first(spark):
    st = spark.createDataFrame([(0, [1], 0), (0, [2], 0), (1, [1], 1_000_000), (1, [2], 1_000_001)], "physical long, module array<int>, v long")
    w = S.pie_wedges(st, "v")
    rows = {(r["physical"], r["ordinal"]): r["end_frac"] for r in w.collect()}
    assert rows[0, 0] == 0.5 and rows[0, 1] == 1.0 and rows[1, 1] == 1.0
    assert {r["physical"]: r["ordinal"] for r in S.dominant_wedges(w).collect()} == {0: 0, 1: 0}


def test_dominant_wedges_round_shares_as_their_sql_does(spark):
    pairs = [(1_999_999, 2_000_001), (999_998, 1_000_001), (999_999, 1_000_002), (2_000_001, 1_999_999)]  # differences of half to one and a half millionths
    st = spark.createDataFrame([(p, [m + 1], v) for p, pair in enumerate(pairs) for m, v in enumerate(pair)], "physical long, module array<int>, v long")
    half_up = lambda x: int(x + 0.5)
    want = {p: int(half_up(b / (a + b) * 1e6) > half_up(a / (a + b) * 1e6)) for p, (a, b) in enumerate(pairs)}
    assert {r["physical"]: r["ordinal"] for r in S.dominant_wedges(S.pie_wedges(st, "v")).collect()} == want


def test_runs(spark):
    ids = [1, 2, 3, 7, 9, 10, 2]
    rows = G.instance_runs(spark.createDataFrame([(i,) for i in ids], "id long")).collect()
    assert sorted((r["start"], r["stop"]) for r in rows) == [(1, 4), (7, 8), (9, 11)]


def test_dense_index_numbers_in_order(spark):
    from gridloom.plans.storage import dense_index

    values = list(range(1000))
    random.Random(3).shuffle(values)
    rows = dense_index(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), ["v"], "i", start=5).collect()
    assert all(r["i"] == r["v"] + 5 for r in rows)


def test_empty_tables(spark):
    e = edges(spark, [])
    assert G.adjacency(e).count() == 0 and G.reciprocal_edges(e).count() == 0 and G.self_loops(e).count() == 0
    assert G.spring_unit(e).first()["unit"] == 0.0
    assert G.degree_strength(spark.range(2), e).filter("degree = 0").count() == 2
