"""Registry shared by the query modules: name -> spark callable and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The oracles without the fleet views, for oracles composed of others.
BODY: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB oracle over the fleet views (None: no SQL twin)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            BODY[name] = sql
            ORACLE[name] = with_views(sql)
        return fn

    return deco
