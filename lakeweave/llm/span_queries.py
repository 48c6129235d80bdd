"""p1: stretches of tool results that stand in other results too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm.shared_spans import shared_share, shared_spans
from lakeweave.sources.tables import table


def found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "results").select("result_id", "text")).drop("n_chars")


def share(spark: SparkSession, folder: str) -> DataFrame:
    return shared_share(table(spark, folder, "results").select("result_id", "text"))


QUERIES = {"p1_found": found, "p1_shared_share": share}

# every window of 200 characters by its hash: no more than a check on small tables can bear
_WINDOWS = """t AS (SELECT result_id, max(text) AS text FROM results WHERE result_id IS NOT NULL AND len(text) >= 200 GROUP BY result_id),
w AS (SELECT result_id, i, hash(text[i:i + 199]) AS h FROM (SELECT result_id, text, unnest(range(1, len(text) - 198)) AS i FROM t)),
s AS (SELECT h FROM w GROUP BY h HAVING min(result_id) <> max(result_id)),
p AS (SELECT result_id, i, i - lag(i) OVER (PARTITION BY result_id ORDER BY i) AS step FROM w SEMI JOIN s USING (h)),
g AS (SELECT result_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY result_id ORDER BY i) AS island FROM p),
spans AS (SELECT result_id, CAST(min(i) - 1 AS INTEGER) AS span_start, CAST(max(i) + 199 AS INTEGER) AS span_end FROM g GROUP BY result_id, island)"""
SQL = {
    "p1_found": f"WITH {_WINDOWS} SELECT * FROM spans",
    "p1_shared_share": f"""WITH {_WINDOWS}, e AS (SELECT result_id, max(coalesce(len(text), 0)) AS n_chars FROM results WHERE result_id IS NOT NULL GROUP BY result_id),
        a AS (SELECT result_id, count(*) AS n_spans, sum(span_end - span_start) AS shared_chars FROM spans GROUP BY result_id)
        SELECT result_id, n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN round(coalesce(shared_chars, 0) / n_chars, 4) END AS shared_share FROM e LEFT JOIN a USING (result_id)""",
}
