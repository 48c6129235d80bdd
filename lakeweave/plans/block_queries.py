"""Compaction of documents by blocks, from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import text as X
from lakeweave.operators import blocks as B, documents as D
from lakeweave.plans.document_queries import QUESTION, SQL as DOCUMENT_SQL
from lakeweave.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return B.parts(_docs(spark, folder), QUESTION)


def compact_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text after the chain, with what was taken out."""
    return B.compact(_docs(spark, folder), QUESTION)[2]


def block_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return B.explained(B.compact(_docs(spark, folder), QUESTION)[1])


def sufficiency_check(spark: SparkSession, folder: str) -> DataFrame:
    p, d, _ = B.compact(_docs(spark, folder), QUESTION)
    return B.sufficiency(p, d)


def context_units(spark: SparkSession, folder: str) -> DataFrame:
    p, d, _ = B.compact(_docs(spark, folder), QUESTION)
    return B.representation(p, d, QUESTION).select("doc_id", F.to_json("units").alias("units"), F.to_json("selection").alias("selection"))


def ablation(spark: SparkSession, folder: str) -> DataFrame:
    return B.ablation(_parts(spark, folder))


def floor(spark: SparkSession, folder: str) -> DataFrame:
    return B.rule_floor(_parts(spark, folder))


def sticky(spark: SparkSession, folder: str) -> DataFrame:
    """A second pass with a greater share, after the decisions of a first one that were not by score alone."""
    p, first, _ = B.compact(_docs(spark, folder), QUESTION)
    cache = first.filter("reason <> 'scored'").join(p.filter("is_block").select("doc_id", "idx", "key"), ["doc_id", "idx"]).select(F.lit("q1").alias("identity"), "key", "action", "reason")
    return B.sticky(B.decide(p, QUESTION, 0.5), p, cache, "q1").groupBy("reused", "action").agg(F.count("*").alias("n"))


def case_results(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a case: its first three terms must stand in the cleaned text, and cleaning may save a tenth at most."""
    t = D.clean(_docs(spark, folder))
    cases = t.select(F.col("doc_id").alias("id"), F.slice(F.regexp_extract_all("text", F.lit(r"[a-z]{5,}"), 0), 1, 3).alias("required"), F.array(F.lit("Sent from my")).alias("forbidden"), F.lit(None).cast("double").alias("min_saved"), F.lit(10.0).alias("max_saved"), F.lit(1.0).alias("min_recall"))
    out = t.select(F.col("doc_id").alias("id"), F.col("unique").alias("text"), X.token_estimate(F.col("text")).alias("tokens_before"), X.token_estimate(F.col("unique")).alias("tokens_after"))
    return B.case_results(cases, out)


def suite(spark: SparkSession, folder: str) -> DataFrame:
    return B.suite(case_results(spark, folder))


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    return B.rendered(*(table(spark, folder, n) for n in ("messages", "calls", "results")))


QUERIES = {
    "compact_blocks": compact_blocks, "block_decisions": block_decisions, "sufficiency_check": sufficiency_check, "context_units": context_units, "block_ablation": ablation, "rule_floor": floor,
    "sticky_decisions": sticky, "case_results": case_results, "suite_summary": suite, "rendered_segments": rendered,
}

_SAV = DOCUMENT_SQL["optimize_savings"].rsplit("SELECT * FROM sav", 1)[0]
_CASES = f"""{_SAV}, k AS (SELECT c.doc_id AS id, regexp_extract_all(c.text, '[a-z]{{5,}}')[:3] AS required, c.uniq AS text, s.saved_percent FROM clean c JOIN sav s USING (doc_id)),
r AS (SELECT id, saved_percent, CASE WHEN len(required) = 0 THEN 1.0 ELSE round(len(list_filter(required, lambda m: contains(text, m))) / len(required), 4) END AS recall, CASE WHEN contains(text, 'Sent from my') THEN 1 ELSE 0 END AS n_forbidden FROM k),
cases AS (SELECT *, concat_ws(',', CASE WHEN saved_percent > 10 THEN 'max_saved' END, CASE WHEN recall < 1 THEN 'min_recall' END, CASE WHEN n_forbidden > 0 THEN 'forbidden' END) AS failed_gates FROM r)"""
SQL = {
    "case_results": f"{_CASES} SELECT id, saved_percent, recall, n_forbidden, failed_gates = '' AS passed, failed_gates FROM cases",
    "suite_summary": f"{_CASES} SELECT count(*) AS n_cases, count(*) FILTER (failed_gates = '') AS n_passed, count(*) FILTER (failed_gates <> '') AS n_failed, round(avg(saved_percent), 2) AS mean_saved, round(avg(recall), 4) AS mean_recall FROM cases",
    "rendered_segments": """WITH m AS (SELECT session_id, message_index, max({'role': lower(trim(role)), 'n': len(text)}) AS m FROM messages WHERE session_id IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL),
        mm AS (SELECT session_id, message_index, CASE WHEN coalesce(m.role, '') = 'tool' THEN 'user' ELSE coalesce(m.role, '') END AS role, coalesce(m.n, 0) AS n FROM m),
        c AS (SELECT session_id, message_index, pos, call_id, min(tool) AS tool, max(len(coalesce(input_json, '{}'))) AS n FROM calls WHERE session_id IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL), nm AS (SELECT session_id, call_id, min(tool) AS tool FROM c GROUP BY ALL),
        r AS (SELECT session_id, message_index, pos, result_id, call_id, max(len(coalesce(text, ''))) AS n FROM results WHERE session_id IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL),
        e AS (SELECT session_id, message_index, 0 AS k, 0 AS pos, 'text' AS kind, NULL AS tool, n FROM mm WHERE n > 0 UNION ALL SELECT session_id, message_index, 1, pos, 'tool_use', tool, n FROM c UNION ALL SELECT r.session_id, message_index, 2, pos, 'tool_result', nm.tool, n FROM r LEFT JOIN nm ON nm.session_id = r.session_id AND nm.call_id = r.call_id),
        h AS (SELECT e.session_id, e.message_index, k, pos, kind, tool, e.n, coalesce(mm.role, 'user') AS role, '[m' || lpad(CAST(e.message_index AS VARCHAR), greatest(4, len(CAST(e.message_index AS VARCHAR)))::INT, '0') || ' ' || coalesce(mm.role, 'user') || ' ' || kind || coalesce(' ' || tool, '') || ']' AS header FROM e LEFT JOIN mm ON mm.session_id = e.session_id AND mm.message_index = e.message_index),
        s AS (SELECT *, len(header) + 1 + n AS size, row_number() OVER w AS part, coalesce(sum(len(header) + 3 + n) OVER (PARTITION BY session_id ORDER BY message_index, k, pos, header, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM h WINDOW w AS (PARTITION BY session_id ORDER BY message_index, k, pos, header, n))
        SELECT session_id, CAST(part AS INTEGER) AS part, message_index, role, kind, tool, header, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + size AS BIGINT) AS char_end FROM s""",
}
