"""Queries over G1, G2 and the state network S."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import graph as G
from gridloom.operators import states as S
from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.plans.fixtures import with_

G1_LINKS = f"WITH g1 AS (SELECT l_partkey % {X.NODES} AS source, l_orderkey % {X.NODES} AS target, CAST(l_quantity AS BIGINT) AS weight FROM lineitem), {X.SQL['g1n']}\n"


@query(
    G1_LINKS
    + """, e AS (SELECT source AS id, weight FROM g1 UNION ALL SELECT target, weight FROM g1 WHERE source <> target)
SELECT g1n.id, count(e.id) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS strength FROM g1n LEFT JOIN e ON e.id = g1n.id GROUP BY g1n.id"""
)
def graph_degree(spark, sf_dir):
    return G.degree_strength(X.g1_nodes(spark), X.g1_links(spark, sf_dir))


@query(
    with_(
        "g1",
        """, e AS (SELECT edge_id, 0 AS side, source AS id, target AS neighbor, weight FROM g1 UNION ALL SELECT edge_id, 1, target, source, weight FROM g1)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY edge_id, side) - 1 AS pos, neighbor, weight FROM e""",
    )
)
def graph_adjacency(spark, sf_dir):
    return G.adjacency(X.g1(spark, sf_dir))


@query(with_("g1", "SELECT e.edge_id, coalesce(max(b.edge_id), -1) AS reciprocal FROM g1 e LEFT JOIN (SELECT source, target, max(edge_id) AS edge_id FROM g1 GROUP BY ALL) b ON b.source = e.target AND b.target = e.source GROUP BY e.edge_id"))
def reciprocal_edges(spark, sf_dir):
    return G.reciprocal_edges(X.g1(spark, sf_dir))


@query(with_("g1", "SELECT source AS node, min(edge_id) AS first_edge, CAST(sum(weight) AS BIGINT) AS weight FROM g1 WHERE source = target GROUP BY source"))
def self_loop_index(spark, sf_dir):
    return G.self_loops(X.g1(spark, sf_dir))


@query(with_("g1", ", l AS (SELECT min(edge_id) AS edge_id FROM g1 WHERE source = target GROUP BY source), o AS (SELECT edge_id, row_number() OVER (ORDER BY edge_id) - 1 AS loop FROM l) SELECT g1.edge_id, coalesce(o.loop, -1) AS loop FROM g1 LEFT JOIN o USING (edge_id)"))
def loop_of_edge(spark, sf_dir):
    return G.loop_of_edge(X.g1(spark, sf_dir))


def _tens(spark):
    return X.g1_nodes(spark).select("id", (F.col("id") % 37).alias("grp"))


@query(with_("g1", "SELECT source % 37 AS source, target % 37 AS target, CAST(sum(weight) AS BIGINT) AS weight, min(edge_id) AS first_edge FROM g1 GROUP BY 1, 2"))
def merge_groups(spark, sf_dir):
    return G.merge_groups(X.g1(spark, sf_dir), _tens(spark))


@query(with_("g1n", "SELECT id % 37 AS grp, row_number() OVER (PARTITION BY id % 37 ORDER BY id) - 1 AS pos, id FROM g1n"))
def group_members(spark, sf_dir):
    return G.group_members(_tens(spark))


@query("SELECT c_custkey % 37 AS grp, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS flow FROM customer GROUP BY 1")
def group_flow(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    values = c.select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("flow"))
    return G.group_flow(values, c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 37).alias("grp")))


@query(with_("g1", "SELECT edge_id, source, target, weight FROM g1 WHERE source <> target AND source % 3 = 0 AND target % 3 = 0"))
def leaf_links(spark, sf_dir):
    return G.leaf_links(X.g1(spark, sf_dir), X.g1_nodes(spark).filter("id % 3 = 0")).select("edge_id", "source", "target", "weight")


@query(G1_LINKS + "SELECT round(count(*) / sum(weight), 9) AS unit FROM g1 WHERE source <> target")
def spring_unit(spark, sf_dir):
    return G.spring_unit(X.g1_links(spark, sf_dir)).select(F.round("unit", 9).alias("unit"))


@query(with_("g1", "SELECT least(source % 37, target % 37) AS source, greatest(source % 37, target % 37) AS target, CAST(sum(weight) AS BIGINT) AS weight FROM g1 WHERE source % 37 <> target % 37 GROUP BY 1, 2"))
def coarse_edges(spark, sf_dir):
    return G.coarse_edges(X.g1(spark, sf_dir), _tens(spark))


@query("WITH d AS (SELECT DISTINCT l_partkey * 3 + l_linenumber % 2 AS id FROM lineitem), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS k FROM d) SELECT min(id) AS start, max(id) + 1 AS stop FROM g GROUP BY k")
def instance_runs(spark, sf_dir):
    return G.instance_runs(X.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 3 + F.col("l_linenumber") % 2).alias("id")))


@query(with_("s se", "SELECT a.physical AS source, b.physical AS target, CAST(sum(weight) AS BIGINT) AS weight, min(edge_id) AS first_edge FROM se JOIN s a ON a.state = source JOIN s b ON b.state = target GROUP BY 1, 2"))
def state_physical(spark, sf_dir):
    return S.physical_network(X.states(spark, sf_dir), X.state_edges(spark, sf_dir))


def _modules(spark, sf_dir):
    """States by status: three modules."""
    s = X.states(spark, sf_dir)
    module = F.array(F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 2).otherwise(3).cast("long"))
    return s.select("state", "physical", module.alias("module"))


MODULES = ", m AS (SELECT state, physical, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS m FROM s), l AS (SELECT physical, m % 2 AS module, min(state) AS first_state, count(*) AS members FROM m GROUP BY ALL), lump AS (SELECT row_number() OVER (ORDER BY physical, first_state) - 1 AS lump, * FROM l)"


def _lumps(spark, sf_dir):
    return S.lumps(_modules(spark, sf_dir).select("state", "physical", (F.element_at("module", 1) % 2).alias("module")))


@query(with_("s", MODULES + " SELECT lump, physical, CAST(module AS BIGINT) AS module, first_state, members FROM lump"))
def lump_states(spark, sf_dir):
    return _lumps(spark, sf_dir).select("lump", "physical", "module", "first_state", "members")


@query(with_("s", MODULES + ", r AS (SELECT lump, CAST(module AS BIGINT) AS module, row_number() OVER (PARTITION BY module ORDER BY members DESC, lump) AS r FROM lump) SELECT lump, module, CASE WHEN module = 1 THEN CASE WHEN r < 2 THEN r WHEN r < 4 THEN r + 1 ELSE r + 2 END ELSE r END AS rank FROM r"))
def lump_ranks(spark, sf_dir):
    taken = spark.createDataFrame([(1, 2), (1, 5)], "module long, branch long")
    return S.lump_ranks(_lumps(spark, sf_dir), "members", taken)


PIES = ", m AS (SELECT o_custkey AS physical, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS module, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders), g AS (SELECT physical, module, sum(v) AS v FROM m GROUP BY ALL), w AS (SELECT physical, row_number() OVER p - 1 AS ordinal, [module] AS module, CAST(v AS DOUBLE) / sum(v) OVER (PARTITION BY physical) AS share, CAST(sum(v) OVER p AS DOUBLE) / sum(v) OVER (PARTITION BY physical) AS end_frac FROM g WINDOW p AS (PARTITION BY physical ORDER BY module))"


def _pies(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    module = F.array(F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3))
    return S.pie_wedges(o.select(F.col("o_custkey").alias("physical"), module.alias("module"), F.round("o_totalprice").cast("long").alias("v")), "v")


@query("WITH " + PIES[2:] + " SELECT physical, ordinal, module[1] AS module, round(share, 9) AS share, round(end_frac, 9) AS end_frac FROM w")
def pie_wedges(spark, sf_dir):
    return _pies(spark, sf_dir).select("physical", "ordinal", F.element_at("module", 1).alias("module"), F.round("share", 9).alias("share"), F.round("end_frac", 9).alias("end_frac"))


@query("WITH " + PIES[2:] + " SELECT physical, arg_max(ordinal, v) AS ordinal FROM (SELECT physical, ordinal, round(share * 1000000) * 10 - ordinal AS v FROM w) GROUP BY physical")
def dominant_wedge(spark, sf_dir):
    return S.dominant_wedges(_pies(spark, sf_dir))
