"""References, later changes, versions, stash decisions and trims, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import fixed
from lakeweave.operators import relating as L
from lakeweave.operators import transcript as R
from lakeweave.plans.transcript_queries import _RULES, _STREAM, _SUP, SQL as _TRANSCRIPT, _lst, _rules, _stream
from lakeweave.sources.tables import table


def named_calls(spark, folder):
    return L.named_calls(_stream(spark, folder), table(spark, folder, "results"))


def later_writes(spark, folder):
    return L.later_writes(_stream(spark, folder))


def path_references(spark, folder):
    return L.path_references(_stream(spark, folder))


def version_changes(spark, folder):
    return L.version_changes(R.superseded(_stream(spark, folder)), R.results_last(table(spark, folder, "results")))


def stash_decisions(spark, folder):
    return L.stash_decisions(_rules(spark, folder), R.pointers(_stream(spark, folder)), R.repeated_ids(table(spark, folder, "calls")))


def line_reasons(spark, folder):
    return L.line_reasons(table(spark, folder, "raw_log"))


def folded(spark, folder):
    return L.folded_frequency(table(spark, folder, "documents"))


def safe_trims(spark, folder):
    return L.safe_trims(table(spark, folder, "documents")).select("doc_id", "content_type", "n_chars", F.length("trimmed").alias("n_kept"))


QUERIES = {
    "named_calls": named_calls, "later_writes": later_writes, "path_references": path_references, "version_changes": version_changes,
    "stash_decisions": stash_decisions, "line_reasons": line_reasons, "folded_frequency": folded, "safe_trims": safe_trims,
}

_REFS = f"list_distinct(list_filter(list_concat(regexp_extract_all(text, 'https?://\\S+'), regexp_extract_all(text, '{L.SLASHED}'), regexp_extract_all(text, '{L.FILE_NAME}')), lambda r: len(r) >= 4))"
_EDIT = f"CASE WHEN tool IN {_lst(fixed.EDIT_TOOLS)} THEN 1 ELSE 0 END"


def _later(by: str) -> str:
    return f"coalesce(sum({_EDIT}) OVER (PARTITION BY session_id, {by} ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)"


SQL = {
    "named_calls": f"""WITH {_STREAM}, r AS (SELECT DISTINCT session_id, unnest({_REFS}) AS ref FROM results WHERE session_id IS NOT NULL),
        j AS (SELECT s.session_id, ref, call_id, seq FROM s JOIN r ON s.session_id = r.session_id AND (path = ref OR ends_with(path, '/' || ref)))
        SELECT session_id, ref, arg_max(call_id, seq) AS call_id, max(seq) AS seq FROM j GROUP BY session_id, ref""",
    "later_writes": f"WITH {_STREAM}, f AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder FROM s WHERE path IS NOT NULL), w AS (SELECT *, {_later('path')} AS writes_same, {_later('folder')} AS writes_near FROM f) SELECT session_id, call_id, seq, writes_same, writes_near FROM w WHERE tool = 'read'",
    "path_references": f"WITH {_STREAM} SELECT path, count(*) AS n_calls, count(DISTINCT session_id) AS n_sessions, sum({_EDIT}) AS n_edits FROM s WHERE path IS NOT NULL GROUP BY path",
    "version_changes": f"""WITH {_STREAM}, {_SUP}, p AS (SELECT sup.session_id, sup.call_id, superseded_by, string_split(coalesce(a.text, ''), chr(10)) AS x, string_split(coalesce(b.text, ''), chr(10)) AS y FROM sup JOIN r1 a ON a.session_id = sup.session_id AND a.call_id = sup.call_id JOIN r1 b ON b.session_id = sup.session_id AND b.call_id = superseded_by),
        q AS (SELECT *, list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) AS d FROM p)
        SELECT session_id, call_id, superseded_by, len(x) AS n_lines, CASE WHEN coalesce(d, 0) = 0 THEN least(len(x), len(y)) ELSE d - 1 END AS stable_lines FROM q""",
    "stash_decisions": f"""WITH {_RULES}, pt AS ({_TRANSCRIPT["identical_output_pointers"].replace(f"WITH {_STREAM}, p AS", "SELECT session_id, call_id, points_to FROM (WITH p AS", 1)})), rep AS (SELECT session_id, call_id FROM c1 GROUP BY ALL HAVING count(*) > 1)
        SELECT d.session_id, d.call_id, CASE WHEN rep.call_id IS NOT NULL THEN 'keep' WHEN points_to IS NOT NULL AND reason <> 'pinned' THEN 'point' WHEN action IN ('drop', 'trim') AND n_chars > 60 THEN 'stash' ELSE 'keep' END AS action,
        CASE WHEN rep.call_id IS NOT NULL THEN 'repeated_id' WHEN points_to IS NOT NULL AND reason <> 'pinned' THEN points_to WHEN action IN ('drop', 'trim') AND n_chars > 60 THEN reason ELSE 'not_eligible' END AS reason
        FROM rules d LEFT JOIN pt ON pt.session_id = d.session_id AND pt.call_id = d.call_id LEFT JOIN rep ON rep.session_id = d.session_id AND rep.call_id = d.call_id""",
    "line_reasons": "SELECT CASE WHEN line IS NULL OR trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'not_json' WHEN json_type(line) <> 'OBJECT' THEN 'not_object' WHEN json_extract_string(line, '$.type') IS NULL THEN 'no_type' ELSE 'ok' END AS reason, count(*) AS n FROM raw_log GROUP BY 1",
    "folded_frequency": "SELECT term, count(*) AS n_docs FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda w: len(w) >= 3 AND w NOT IN " + _lst(fixed.STOPWORDS) + "))) AS term FROM documents) GROUP BY term",
}
