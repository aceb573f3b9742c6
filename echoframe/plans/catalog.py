"""The registry of queries: a DataFrame builder and, where SQL can express it, the same rows in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its twin."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name}: registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every module that registers queries."""
    from . import chain_queries, geometry_queries, kernel_queries, radiometry_queries, raster_queries, signal_queries  # noqa: F401

    return QUERIES, ORACLE_SQL
