"""The registered queries of the graph engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, folder) under ``name``, with DuckDB SQL for the same rows."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def load() -> None:
    from netloom.plans import context_queries, detail_queries, link_queries, listing_queries, read_queries, scalar_queries, search_queries, series_queries, store_queries, stream_queries, walk_queries  # noqa: F401


load()
