"""Queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows in DuckDB."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query registered before."""
    return _SQL[name]


def queries() -> dict[str, Query]:
    from windrose.plans import audit_queries, flight_queries, layer_queries, model_queries, report_queries, scalar_queries, source_queries, temporal_queries, weather_tables  # noqa: F401

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL
