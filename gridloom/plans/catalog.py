"""Registry of queries: a name, a DataFrame plan over the supplied tables, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name."""

    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return add


def queries() -> dict[str, Plan]:
    from gridloom.plans import frontier_queries, geo_queries, glyph_queries, graph_queries, hierarchy_queries, layout_queries, source_queries, stream_queries, view_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
