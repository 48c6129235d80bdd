"""All core queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.plans import block_queries, compaction_queries, document_queries, drift_queries, intake_queries, more_queries, nested_queries, relating_queries, rule_queries, stash_queries, transcript_queries

MODULES = (block_queries, rule_queries, intake_queries, stash_queries, document_queries, compaction_queries, transcript_queries, relating_queries, more_queries, nested_queries, drift_queries)
FLAGSHIP = "optimize_savings"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
