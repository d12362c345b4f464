"""Registry of the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarch.plans.sqlbase import query as with_ctes
from scholarch.sources.adapters import Archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, **ctes: str):
    """Decorate `fn(archive) -> DataFrame`; `sql` is its twin (None: rows-only)."""

    def wrap(fn: Callable[[Archive], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Archive(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, **ctes)
        return fn

    return wrap
