"""p4: nested transcripts as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators.nested import flatten, json_nodes, json_rows, merged_schema
from lakeweave.sources.tables import table

MEMBERS = ("command", "file_path", "pattern")


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = table(spark, folder, "transcripts").select("transcript_id", "session_id", "goal", "payload", "archived_at")
    return flatten(t, F.col("transcript_id"), "transcripts")


def _ids(df: DataFrame, *names: str) -> DataFrame:
    """The parts of a surrogate key as numbers, before the other columns."""
    parts = F.split("row_key", "/")
    rest = [c for c in df.columns if c not in ("row_key", "parent_key", "ordinal")]
    return df.select(*[parts.getItem(i).cast("bigint" if i == 0 else "int").alias(n) for i, n in enumerate(names)], "parent_key", *rest)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(_tables(spark, folder)["transcripts.payload"], "transcript_id", "message_index")


def tool_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(_tables(spark, folder)["transcripts.payload.toolUses"], "transcript_id", "message_index", "call_pos")


def tool_results(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(_tables(spark, folder)["transcripts.payload.toolResults"], "transcript_id", "message_index", "result_pos")


def input_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every command, file_path and pattern in a tool use's input, linked to its tool use."""
    uses = tool_uses(spark, folder).select("transcript_id", "message_index", "call_pos", "tool_use_id", "input")
    return json_nodes(uses, "input", MEMBERS).drop("ordinal", "parent_path").distinct()


def input_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs and the elements of every array in them, as rows linked to the row around them."""
    keys = ["transcript_id", "message_index", "call_pos"]
    rows = json_rows(json_nodes(tool_uses(spark, folder).select(*keys, "input"), "input"), keys)
    return rows.select(*keys, "level", "row_key", "parent_key", "ordinal", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("fields"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return input_values(spark, folder).select("transcript_id", "message_index", "call_pos", "json_path").distinct()


def input_schema(spark: SparkSession, folder: str) -> DataFrame:
    return merged_schema(json_nodes(tool_uses(spark, folder).select("input"), "input"))


QUERIES = {"p4_found": found, "p4_messages": messages, "p4_tool_uses": tool_uses, "p4_tool_results": tool_results, "p4_input_values": input_values, "p4_input_rows": input_rows, "p4_input_schema": input_schema}

_ONE = "SELECT DISTINCT ON (transcript_id) transcript_id, payload FROM transcripts ORDER BY transcript_id"
_MESSAGES = f"SELECT transcript_id, CAST(i - 1 AS INTEGER) AS message_index, payload[i] AS m FROM (SELECT transcript_id, payload, unnest(range(1, len(payload) + 1)) AS i FROM ({_ONE}))"


def _elements(field: str, pos: str, columns: str) -> str:
    return (
        f"SELECT transcript_id, message_index, CAST(j - 1 AS INTEGER) AS {pos}, transcript_id || '/' || message_index AS parent_key, {columns} "
        f"FROM (SELECT transcript_id, message_index, j, m.{field}[j] AS e FROM (SELECT *, unnest(range(1, len(m.{field}) + 1)) AS j FROM ({_MESSAGES})))"
    )


SQL = {
    "p4_messages": f"SELECT transcript_id, message_index, CAST(transcript_id AS VARCHAR) AS parent_key, m.role AS role, m.text AS text FROM ({_MESSAGES})",
    "p4_tool_uses": _elements("toolUses", "call_pos", "e.tool_use_id AS tool_use_id, e.tool AS tool, e.input AS input"),
    "p4_tool_results": _elements("toolResults", "result_pos", "e.tool_use_id AS tool_use_id, e.text AS text, e.is_error AS is_error"),
}
_USES = f"""u AS ({SQL["p4_tool_uses"]}),
j AS (SELECT *, CASE WHEN json_valid(input) THEN CASE WHEN json_type(input) = 'VARCHAR' THEN json_extract_string(input, '$') ELSE input END END AS d FROM u),
o AS (SELECT * FROM j WHERE CASE WHEN json_valid(d) THEN json_type(d) = 'OBJECT' ELSE false END),
n AS (SELECT o.*, k.fullkey AS json_path, k.key AS member, k.type AS t, k.atom FROM o, json_tree(o.d) AS k)"""
_WANTED = "member IN ('command', 'file_path', 'pattern') AND t NOT IN ('NULL', 'OBJECT')"
SQL["p4_found"] = f"WITH {_USES} SELECT DISTINCT transcript_id, message_index, call_pos, json_path FROM n WHERE {_WANTED}"
SQL["p4_input_values"] = (
    f"WITH {_USES} SELECT DISTINCT transcript_id, message_index, call_pos, tool_use_id, json_path, member, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind, "
    f"CASE WHEN t = 'VARCHAR' THEN json_extract_string(d, json_path) ELSE CAST(json_extract(d, json_path) AS VARCHAR) END AS value, coalesce(nullif(regexp_extract(json_path, '^(.*\\[[0-9]+\\])', 1), ''), '$') AS row_path FROM n WHERE {_WANTED}"
)
SQL["p4_input_rows"] = f"""WITH {_USES}, k AS (SELECT *, coalesce(nullif(regexp_extract(json_path, '^(.*\\[[0-9]+\\])', 1), ''), '$') AS row_key FROM n)
SELECT transcript_id, message_index, call_pos, regexp_replace(row_key, '\\[[0-9]+\\]', '[]', 'g') AS level, row_key,
  CASE WHEN row_key <> '$' THEN coalesce(nullif(regexp_extract(regexp_replace(row_key, '\\[[0-9]+\\]$', ''), '^(.*\\[[0-9]+\\])', 1), ''), '$') END AS parent_key,
  CAST(nullif(regexp_extract(row_key, '\\[([0-9]+)\\]$', 1), '') AS INTEGER) AS ordinal,
  coalesce(string_agg(DISTINCT CASE WHEN t NOT IN ('OBJECT', 'ARRAY') THEN CASE WHEN json_path = row_key THEN '' ELSE json_path[len(row_key) + 2:] END END, ',' ORDER BY CASE WHEN t NOT IN ('OBJECT', 'ARRAY') THEN CASE WHEN json_path = row_key THEN '' ELSE json_path[len(row_key) + 2:] END END), '') AS fields
FROM k GROUP BY transcript_id, message_index, call_pos, row_key"""
SQL["p4_input_schema"] = (
    f"WITH {_USES}, k AS (SELECT regexp_replace(json_path, '\\[[0-9]+\\]', '[]', 'g') AS field, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM n) "
    "SELECT field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n_values FROM k GROUP BY field"
)
