"""p3: sessions rebuilt from their rows, and those left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import conversations as C
from lakeweave.sources.tables import table

NAMES = ("sessions", "messages", "calls", "results")


def found(spark: SparkSession, folder: str) -> DataFrame:
    return C.reasons(*(table(spark, folder, n) for n in NAMES))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return C.conversations(*(table(spark, folder, n) for n in NAMES)).drop("corrected_at", "early")


def corrected(spark: SparkSession, folder: str) -> DataFrame:
    return C.conversations(*(table(spark, folder, n) for n in NAMES)).drop("text")


def acts(spark: SparkSession, folder: str) -> DataFrame:
    return C.acts(*(table(spark, folder, n) for n in NAMES))


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    return C.clock_offsets(C.events(*(table(spark, folder, n) for n in NAMES[1:])))


QUERIES = {"p3_found": found, "p3_conversations": conversations, "p3_corrected_times": corrected, "p3_acts": acts, "p3_clock_offsets": offsets}

_BLANK = r"regexp_full_match(coalesce(text, ''), '[ \t\r\n]*')"
_FOUND = f"""m AS (SELECT session_id, message_index, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS text, {_BLANK} AS blank FROM messages),
c AS (SELECT DISTINCT session_id, message_index, call_id FROM calls),
r AS (SELECT DISTINCT session_id, message_index, call_id FROM results),
s AS (SELECT DISTINCT session_id FROM sessions),
empty AS (SELECT session_id FROM s EXCEPT (SELECT session_id FROM m WHERE NOT blank UNION SELECT session_id FROM c UNION SELECT session_id FROM r)),
asked AS (SELECT session_id, max(message_index) AS last_asked FROM m WHERE role = 'user' AND NOT blank GROUP BY session_id),
found AS (
  SELECT session_id, 'gap' AS reason FROM m GROUP BY session_id HAVING count(DISTINCT message_index) <> max(message_index) + 1 OR min(message_index) <> 0
  UNION SELECT session_id, 'no_role' FROM m WHERE role = ''
  UNION SELECT session_id, 'conflict' FROM m WHERE message_index IS NOT NULL GROUP BY session_id, message_index HAVING count(DISTINCT role) > 1 OR count(DISTINCT text) > 1
  UNION SELECT session_id, 'unanswered_call' FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.session_id = c.session_id AND r.call_id = c.call_id)
  UNION SELECT session_id, 'orphan_result' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE r.session_id = c.session_id AND r.call_id = c.call_id)
  UNION SELECT session_id, 'result_before_call' FROM r WHERE EXISTS (SELECT 1 FROM c WHERE r.session_id = c.session_id AND r.call_id = c.call_id)
    AND NOT EXISTS (SELECT 1 FROM c WHERE r.session_id = c.session_id AND r.call_id = c.call_id AND c.message_index < r.message_index)
  UNION SELECT session_id, 'no_reply' FROM asked a WHERE NOT EXISTS (
    SELECT 1 FROM m WHERE m.session_id = a.session_id AND m.role = 'assistant' AND m.message_index > a.last_asked
      AND (NOT m.blank OR EXISTS (SELECT 1 FROM c WHERE c.session_id = m.session_id AND c.message_index = m.message_index)))
),
reasons AS (SELECT session_id, 'empty' AS reason FROM empty UNION SELECT f.session_id, reason FROM found f SEMI JOIN s USING (session_id) ANTI JOIN empty USING (session_id)),
kept AS (SELECT session_id FROM s EXCEPT SELECT session_id FROM reasons)"""
SQL = {
    "p3_found": f"WITH {_FOUND} SELECT * FROM reasons",
    # a kept session has one message for each index
    "p3_conversations": f"""WITH {_FOUND} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS INTEGER) AS turn, message_index, lower(trim(coalesce(any_value(role), ''))) AS role, coalesce(max(text), '') AS text, min(sent_at) AS sent_at
        FROM messages SEMI JOIN kept USING (session_id) GROUP BY session_id, message_index""",
    "p3_acts": f"""WITH {_FOUND}, once AS (SELECT DISTINCT ON (session_id, call_id) session_id, call_id, text AS result_text, is_error FROM results WHERE call_id IS NOT NULL ORDER BY session_id, call_id, message_index, pos, result_id),
        call AS (SELECT DISTINCT ON (session_id, message_index, pos, call_id) session_id, message_index, pos, call_id, tool, input_json FROM calls ORDER BY session_id, message_index, pos, call_id, tool NULLS FIRST, input_json NULLS FIRST)
        SELECT session_id, message_index, pos, call_id, tool, input_json, result_text, is_error FROM call SEMI JOIN kept USING (session_id) LEFT JOIN once USING (session_id, call_id)""",
}
