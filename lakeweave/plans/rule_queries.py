"""Lossless and recoverable rules over all sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import text as X
from lakeweave.operators import rules as U, transcript as R
from lakeweave.sources.tables import table


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results").select("session_id", "call_id", "message_index", "pos", "result_id", "text", "is_error")


def lossless(spark: SparkSession, folder: str) -> DataFrame:
    return U.lossless(_results(spark, folder), R.repeated_ids(table(spark, folder, "calls")))


def lossless_verify(spark: SparkSession, folder: str) -> DataFrame:
    """How many decisions of each kind there are, and how many pointers cannot be followed back."""
    d = lossless(spark, folder)
    bad = U.broken_pointers(_results(spark, folder), d)
    return d.join(bad, ["session_id", "call_id"], "left").groupBy("decision", "reason").agg(F.count("*").alias("n"), F.count("problem").alias("n_broken"))


def recoverable(spark: SparkSession, folder: str) -> DataFrame:
    return U.recoverable(R.stream(table(spark, folder, "calls"), table(spark, folder, "results")))


def read_only_commands(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "calls").filter(X.tool_name(F.col("tool")).isin(*U.SHELLS)).select("command").distinct()
    return c.filter("command is not null").select("command", U.is_read_only("command").alias("read_only"))


QUERIES = {"lossless_decisions": lossless, "lossless_verify": lossless_verify, "recoverable_decisions": recoverable, "read_only_commands": read_only_commands}
SQL: dict[str, str] = {}
