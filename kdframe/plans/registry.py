"""Name → (Spark query, DuckDB oracle SQL) registry filled by the ``*_queries`` modules."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all():
    from . import (data_queries, eval_queries, fit_queries, format_queries, preference_queries,  # noqa: F401
                   score_queries, sequence_queries, token_queries)
    return QUERIES, ORACLE
