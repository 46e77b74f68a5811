"""Registered queries: for each name a Spark job ``(spark, sf_dir) -> DataFrame`` and,
where the operator is expressible in plain SQL, the equivalent DuckDB oracle text over
the same base tables.

Modules add entries with :func:`register`; ``__spark_entry__`` exposes the two maps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from .plans import (cart_queries, catalog_queries, checkout_queries, domain_queries, eval_queries, guard_queries, intake_queries,  # noqa: F401
                        lake_queries, mart_queries, saga_queries, search_queries, stock_queries, talk_queries)
