"""Queries by name with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def same(name: str, of: str) -> None:
    """Register a query by an earlier name, too."""
    QUERIES[name] = QUERIES[of]
    if of in SQL:
        SQL[name] = SQL[of]
