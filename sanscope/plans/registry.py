"""Registry of named queries: key -> (spark builder, DuckDB oracle statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for m in MODULES:
        importlib.import_module(f"sanscope.plans.{m}")


MODULES = ("q_certs", "q_db", "q_lookups", "q_html", "q_io", "q_stream")
