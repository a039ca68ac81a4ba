"""The registered queries and, where SQL can say it, the statement each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def load_all() -> None:
    from tagweave.plans import (  # noqa: F401
        dialogue_queries,
        exchange_queries,
        graph_queries,
        item_queries,
        source_queries,
        stream_queries,
        vector_queries,
    )
