"""Queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import conversation_queries, corpus_queries, near_dup_queries, pii_queries, span_queries

MODULES = (span_queries, corpus_queries, conversation_queries, near_dup_queries, pii_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
