"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with DuckDB's SQL for its rows if SQL can express them."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from gateloom.plans import analysis_queries, engine_queries, gate_queries, method_queries, scalar_queries, source_queries, statistic_queries, surface_queries  # noqa: E402, F401
