"""Registry: a query and, where SQL can express it, the SQL text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlantern.sources.fixture import duckdb_with

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


_MADE: dict = {}


def once(spark: SparkSession, sf_dir: str, what: str, make: Callable):
    """Stored tables and trained models that several queries of a session share."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register a query. ``sql`` sees the named fixture views as CTEs; it may add CTEs with a leading ``,``."""

    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            if views:
                head = "WITH RECURSIVE " if recursive else "WITH "
                text = head + duckdb_with(*views) + ("" if text.startswith(",") else "\n") + text
            ORACLES[name] = text
        return fn

    return deco
