"""Registry of named catalogue queries and their DuckDB oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` (with oracle SQL
    when the result is expressible in plain SQL)."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key!r}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so the registry is complete."""
    from . import (q_views, q_zones, q_merge, q_text, q_vectors,  # noqa: F401
                   q_completions, q_sources, q_ingest, q_stream)
