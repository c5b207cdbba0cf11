"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load() -> tuple[dict, dict]:
    """Import every query module and return (queries, oracle SQL)."""
    from . import (bpe_queries, decontam_queries, dedup_queries, html_queries, langid_queries, licence_queries,  # noqa: F401
                   mixing_queries, quality_queries, spelling_queries, tokencount_queries, topk_queries, trie_queries)
    return dict(QUERIES), dict(ORACLE)
