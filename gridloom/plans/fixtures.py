"""The graph, hierarchy and point tables that the registered queries derive from the supplied tables.

Each has a DataFrame builder and, under the same name in ``SQL``, its DuckDB definition for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.plans.storage import dense_index

NODES = 499
LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 without edge ids: a directed multigraph with self-loops and reciprocal links."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % NODES).alias("source"), (F.col("l_orderkey") % NODES).alias("target"), F.col("l_quantity").cast("long").alias("weight"))


def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dense_index(table(spark, sf_dir, "lineitem").select(*LINEITEM), list(LINEITEM), "edge_id")
    return rows.select("edge_id", (F.col("l_partkey") % NODES).alias("source"), (F.col("l_orderkey") % NODES).alias("target"), F.col("l_quantity").cast("long").alias("weight"))


def g1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with the whole row as edge_id: it has the order of G1's numbers without numbering any row."""
    return table(spark, sf_dir, "lineitem").select(F.struct(*LINEITEM).alias("edge_id"), (F.col("l_partkey") % NODES).alias("source"), (F.col("l_orderkey") % NODES).alias("target"), F.col("l_quantity").cast("long").alias("weight"))


def g1_nodes(spark: SparkSession) -> DataFrame:
    return spark.range(NODES)


def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer transitions: each order's customer to the next order's."""
    ranked = dense_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "edge_id")
    after = ranked.select((F.col("edge_id") - 1).alias("edge_id"), F.col("o_custkey").alias("target"))
    return ranked.join(after, "edge_id").select("edge_id", F.col("o_custkey").alias("source"), "target", F.lit(1).cast("long").alias("weight"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey")


def hierarchy(spark: SparkSession, sf_dir: str, ragged: bool = False) -> DataFrame:
    """H, or H-ragged: (id, path) of every customer."""
    c = customers(spark, sf_dir)
    long = lambda x: F.col(x).cast("long") if isinstance(x, str) else x.cast("long")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    path = F.array(long("n_regionkey") + 1, long("c_nationkey") + 1, long(rank))
    if ragged:
        short = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("c_custkey"))
        path = F.when(F.col("n_regionkey") == 0, F.array(F.lit(1).cast("long"), long(short))).otherwise(path)
    return c.select(F.col("c_custkey").alias("id"), path.alias("path"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P and R: positions, radius and importance of every customer."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(key.alias("id"), F.col("c_acctbal").alias("x"), ((key * 7919) % 10007).cast("double").alias("y"), (1 + key % 5).cast("double").alias("radius"), F.col("c_acctbal").alias("importance"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: state ids for the distinct (customer, order status) pairs."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("physical"), F.col("o_orderstatus").alias("status")).distinct()
    return dense_index(pairs, ["physical", "status"], "state")


def state_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    orders = dense_index(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("physical"), F.col("o_orderstatus").alias("status")), ["o_orderkey"], "edge_id")
    at = orders.join(s, ["physical", "status"]).select("edge_id", "state")
    after = at.select((F.col("edge_id") - 1).alias("edge_id"), F.col("state").alias("target"))
    return at.join(after, "edge_id").select("edge_id", F.col("state").alias("source"), "target", F.lit(1).cast("long").alias("weight"))


SQL = {
    "g1": f"g1 AS (SELECT row_number() OVER (ORDER BY {', '.join(LINEITEM)}) - 1 AS edge_id, l_partkey % {NODES} AS source, l_orderkey % {NODES} AS target, CAST(l_quantity AS BIGINT) AS weight FROM lineitem)",
    "g1n": f"g1n AS (SELECT CAST(range AS BIGINT) AS id FROM range({NODES}))",
    "g2": "g2 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS edge_id, o_custkey AS source, lead(o_custkey) OVER (ORDER BY o_orderkey) AS target, CAST(1 AS BIGINT) AS weight FROM orders QUALIFY lead(o_custkey) OVER (ORDER BY o_orderkey) IS NOT NULL)",
    "h": "h AS (SELECT c_custkey AS id, [CAST(n_regionkey + 1 AS BIGINT), CAST(c_nationkey + 1 AS BIGINT), row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)] AS path FROM customer JOIN nation ON n_nationkey = c_nationkey)",
    "hr": "hr AS (SELECT c_custkey AS id, CASE WHEN n_regionkey = 0 THEN [CAST(1 AS BIGINT), row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey)] ELSE [CAST(n_regionkey + 1 AS BIGINT), CAST(c_nationkey + 1 AS BIGINT), row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)] END AS path FROM customer JOIN nation ON n_nationkey = c_nationkey)",
    "p": "p AS (SELECT c_custkey AS id, c_acctbal AS x, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS y, CAST(1 + c_custkey % 5 AS DOUBLE) AS radius, c_acctbal AS importance FROM customer)",
    "s": "s AS (SELECT physical, status, row_number() OVER (ORDER BY physical, status) - 1 AS state FROM (SELECT DISTINCT o_custkey AS physical, o_orderstatus AS status FROM orders))",
    "se": "se AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS edge_id, state AS source, lead(state) OVER (ORDER BY o_orderkey) AS target, CAST(1 AS BIGINT) AS weight FROM orders JOIN s ON physical = o_custkey AND status = o_orderstatus QUALIFY lead(state) OVER (ORDER BY o_orderkey) IS NOT NULL)",
    # the prefixes of every record, root first; tree: one row per module
    "pre": "pre AS (SELECT id, path, k, path[1:k] AS prefix FROM (SELECT id, path, unnest(range(0, len(path))) AS k FROM {rec}))",
    "tree": "tree AS (SELECT prefix AS path, k AS depth, height, row_number() OVER (ORDER BY height, first_record, k) - 1 + (SELECT count(*) FROM {rec}) AS node, first_record, leaves FROM (SELECT prefix, k, max(len(path)) - k AS height, min(id) AS first_record, count(*) AS leaves FROM pre GROUP BY prefix, k))",
}


def with_(names: str, body: str, rec: str = "h") -> str:
    return "WITH " + ",\n".join(SQL[n].replace("{rec}", rec) for n in names.split()) + "\n" + body
