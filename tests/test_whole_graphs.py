"""Graph queries take part with all of their nodes and links."""

from gridloom.operators import iterate as I
from gridloom.plans import catalog
from gridloom.plans import fixtures as X


def test_multilevel_seed_places_every_node(spark, sf_dir):
    got = [r["id"] for r in catalog.queries()["multilevel_seed"](spark, sf_dir).select("id").collect()]
    assert sorted(got) == sorted(r["id"] for r in X.g1_nodes(spark).select("id").collect())


def test_local_matching_goes_on_until_no_link_is_open(spark):
    n = 46  # a path of growing weights: one pair a round
    e = spark.createDataFrame([(i, i, i + 1, i + 1) for i in range(n)], "edge_id long, source long, target long, weight long")
    groups = {r["id"]: r["grp"] for r in I.local_matching(spark.range(n + 1), e).collect()}
    assert [i for i in range(n) if groups[i] == groups[i + 1]] == list(range(1, n, 2))
