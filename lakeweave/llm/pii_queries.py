"""p9: personal data in posts, listed and masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import pii
from lakeweave.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> tuple[DataFrame, pii.Model]:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs, pii.train(docs, table(spark, folder, "given_names"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(*_docs(spark, folder))


def masked(spark: SparkSession, folder: str) -> DataFrame:
    return pii.masked(*_docs(spark, folder))


QUERIES = {"p9_found": found, "p9_masked": masked}
SQL: dict[str, str] = {}
