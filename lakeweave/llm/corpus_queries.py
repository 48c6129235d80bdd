"""p2, p7, p8: token budgets, containers and mixtures of the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import mixture, packing, token_budget
from lakeweave.llm.tokens import with_tokens
from lakeweave.sources.tables import materialize, table


def budget(spark: SparkSession, folder: str) -> DataFrame:
    names = ("results", "calls", "sessions", "projects", "documents", "sources")
    return token_budget.budget(*(table(spark, folder, n) for n in names))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget.session_totals(*(table(spark, folder, n) for n in ("results", "messages", "reports")))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source, tokens) of every document, counted once."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return materialize(with_tokens(docs, paths=False).select("id", "source", "tokens"), "sized")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sized = _sized(spark, folder).select("id", "tokens")
    sizes = table(spark, folder, "capacities").collect()  # one row per container size
    return reduce(DataFrame.unionByName, [packing.pack_items(sized, r["capacity_tokens"], r["container"]) for r in sorted(sizes, key=lambda r: r["container"])])


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def packed_slack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.slack(_packed(spark, folder))


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(_sized(spark, folder), table(spark, folder, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def mixed_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(_sized(spark, folder), table(spark, folder, "mix_targets"))[1]


QUERIES = {"p2_token_budget": budget, "p2_session_tokens": sessions, "p7_packed": packed, "p7_slack": packed_slack, "p8_mixture": mixed, "p8_shares": mixed_shares}
SQL: dict[str, str] = {}
