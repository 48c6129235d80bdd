"""Stash, hints and reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X
from lakeweave.operators import stash as S, transcript as R
from lakeweave.sources.tables import table

SEARCH = "Traceback timeout config.yaml error WARN DEBUG"


def passes(spark: SparkSession, folder: str) -> DataFrame:
    return S.passes(table(spark, folder, "reports"))


def log_days(spark: SparkSession, folder: str) -> DataFrame:
    return S.request_log(table(spark, folder, "raw_log").select("line"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Every result's id against a stash whose texts lost their carriage returns on the way."""
    r = _results(spark, folder).filter("text is not null")
    kept = r.select(F.sha2("text", 256).alias("sha256"), F.replace("text", F.lit("\r"), F.lit("")).alias("text")).dropDuplicates(["sha256"])
    lost = r.select(F.substring(F.sha2(F.concat("text", F.lit("x")), 256), 1, 12).alias("id"))
    return S.proven(kept, r.select(F.substring(F.sha2("text", 256), 1, 12).alias("id")).unionByName(lost)).groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    return S.listing(_results(spark, folder), table(spark, folder, "messages"))


def collectable(spark: SparkSession, folder: str) -> DataFrame:
    blobs = listing(spark, folder)
    now = _results(spark, folder).agg(F.max("returned_at")).scalar()
    return S.collectable(blobs, now, "30d").select("id12", "created_at")


def search(spark: SparkSession, folder: str) -> DataFrame:
    return S.search(_results(spark, folder).select("result_id", "text"), SEARCH)


def prompt_hints(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").filter("message_index is not null").filter(F.lower(F.trim("role")) == "user").groupBy("session_id", "message_index").agg(F.max("text").alias("text"))
    return S.hints(_results(spark, folder).select("session_id", "result_id", "text"), m)


def lean(spark: SparkSession, folder: str) -> DataFrame:
    return S.lean_notes(_results(spark, folder).select("result_id", "text"))


def _views(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Outputs of reads, and as the files what the last read of each path shows."""
    c = R.calls_once(table(spark, folder, "calls")).filter(X.tool_name(F.col("tool")) == "read").filter("path is not null")
    r = R.results_last(_results(spark, folder)).filter("text is not null")
    v = c.select("session_id", "call_id", "path", "message_index").join(r.select("session_id", "call_id", "result_id", "text"), ["session_id", "call_id"])
    files = v.groupBy("path").agg(F.max_by("text", F.struct("result_id", "text")).alias("content"))
    return v.select(F.concat_ws(":", "session_id", "call_id", F.col("message_index").cast("string")).alias("id"), "path", "text"), files


def disk(spark: SparkSession, folder: str) -> DataFrame:
    return S.disk_states(*_views(spark, folder))


def changed(spark: SparkSession, folder: str) -> DataFrame:
    views, files = _views(spark, folder)
    return S.changed_since(views, files)


QUERIES = {
    "report_passes": passes, "request_log_outcomes": log_days, "stash_verify": verify, "stash_listing": listing, "stash_collectable": collectable, "stash_search": search,
    "prompt_hints": prompt_hints, "lean_notes": lean, "disk_states": disk, "changed_since": changed,
}

_lst = lambda values: ", ".join(f"'{v}'" for v in values)


def _terms(text: str) -> str:
    """A list of (key, weight) as the Spark column gives it."""
    found = f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_][A-Za-z0-9_./:-]*'), lambda w: regexp_replace(w, '[./:-]+$', '')), lambda w: w <> '')"
    parts = "list_filter(list_transform(string_split_regex(w, '[/:]+'), lambda p: regexp_replace(p, '^[.-]+|[.-]+$', '', 'g')), lambda p: p <> '' AND p <> w)"
    every = f"flatten(list_transform({found}, lambda w: CASE WHEN regexp_matches(w, '[/:]') THEN list_concat([w], {parts}) ELSE [w] END))"
    weight = f"CASE WHEN regexp_matches(w, '[0-9_./:-]|[a-z][A-Z]') THEN CASE WHEN len(w) >= 3 THEN 3 ELSE 0 END WHEN len(w) < 4 OR lower(w) IN ({_lst(fixed.STOPWORDS)}) THEN 0 WHEN (regexp_matches(w, '^[A-Z]') AND i > 1) OR len(w) >= 8 THEN 2 ELSE 1 END"
    return f"list_transform({every}, lambda w, i: {{'key': lower(w), 'weight': {weight}}})"


_BLOBS = "b AS (SELECT sha256(text) AS sha256, max(octet_length(encode(text))) AS n_bytes, max(CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)\\z', ''), '\\r\\n|\\r|\\n')) END) AS n_lines, count(DISTINCT session_id) AS n_sessions, min(returned_at) AS created_at FROM results WHERE text IS NOT NULL GROUP BY 1)"
_LISTING = f"""{_BLOBS}, named AS (SELECT id12, count(*) AS refs FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '\\b([0-9a-f]{{12}})\\b', 1))) AS id12 FROM messages) GROUP BY id12),
ls AS (SELECT sha256[:12] AS id12, n_bytes, n_lines, n_sessions, created_at, coalesce(refs, 0) AS n_refs FROM b LEFT JOIN named ON named.id12 = sha256[:12])"""
_VIEWS = """v AS (SELECT c.session_id, c.call_id, c.message_index, c.path, r.result_id, r.text FROM
  (SELECT session_id, message_index, pos, call_id, min(tool) AS tool, min(path) AS path FROM calls WHERE session_id IS NOT NULL AND call_id IS NOT NULL GROUP BY ALL) c
  JOIN (SELECT DISTINCT ON (session_id, call_id) * FROM results WHERE session_id IS NOT NULL AND call_id IS NOT NULL ORDER BY session_id, call_id, message_index DESC, pos DESC, result_id DESC, text DESC NULLS LAST) r USING (session_id, call_id)
  WHERE lower(regexp_replace(trim(c.tool), '^mcp__.*?__', '')) = 'read' AND c.path IS NOT NULL AND r.text IS NOT NULL),
files AS (SELECT path, arg_max(text, {'a': result_id, 'b': text}) AS content FROM v GROUP BY path)"""
_SPLIT = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace({0}, '\\n\\z', ''), chr(10)) END"
SQL = {
    "report_passes": f"""WITH r AS (SELECT DISTINCT ON (report_id) *, CASE WHEN tokens_before BETWEEN 0 AND 1e12 THEN tokens_before END AS b, CASE WHEN tokens_after BETWEEN 0 AND 1e12 THEN tokens_after END AS a, coalesce(schema_version, '') AS s FROM reports),
        k AS (SELECT *, coalesce(CASE WHEN reduction_ratio BETWEEN 0 AND 1e12 THEN reduction_ratio END, CASE WHEN b = 0 THEN 0.0 ELSE greatest(0.0, 1 - a / b) END) AS q FROM r),
        w AS (SELECT *, CASE WHEN NOT (starts_with(s, '{S.BLOCK_REPORT}') OR starts_with(s, '{S.TRANSCRIPT_REPORT}')) THEN 'unsupported_format' WHEN b IS NULL OR a IS NULL OR q > 1 THEN 'invalid_fields' ELSE 'ok' END AS reason FROM k)
        SELECT report_id, reason, CASE WHEN reason = 'ok' THEN CASE WHEN starts_with(s, '{S.BLOCK_REPORT}') THEN 'blocks' WHEN coalesce(mode, 'tool-calls') IN ({_lst(S.MODES)}) THEN coalesce(mode, 'tool-calls') ELSE 'other' END END AS mode,
        CASE WHEN reason = 'ok' THEN CASE WHEN provider_used IN ({_lst(S.PROVIDERS)}) THEN provider_used ELSE 'other' END END AS provider,
        CASE WHEN reason = 'ok' THEN CAST(floor(floor(b) / 100 + 0.5) * 100 AS BIGINT) END AS tokens_before, CASE WHEN reason = 'ok' THEN CAST(floor(floor(a) / 100 + 0.5) * 100 AS BIGINT) END AS tokens_after, CASE WHEN reason = 'ok' THEN floor(q * 100 + 0.5) / 100 END AS ratio FROM w""",
    "request_log_outcomes": "SELECT CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN 'kept' ELSE 'skipped' END AS outcome, count(*) AS n FROM raw_log WHERE coalesce(trim(line), '') <> '' GROUP BY 1",
    "stash_verify": """WITH t AS (SELECT DISTINCT text FROM results WHERE text IS NOT NULL), ids AS (SELECT sha256(text)[:12] AS id, contains(text, chr(13)) AS cut FROM t),
        lost AS (SELECT DISTINCT sha256(text || 'x')[:12] AS id FROM t) SELECT outcome, count(*) AS n, min(id) AS first_id FROM (SELECT id, CASE WHEN bool_or(cut) THEN 'hash_mismatch' ELSE 'ok' END AS outcome FROM ids GROUP BY id
        UNION ALL SELECT id, 'missing' FROM lost ANTI JOIN ids USING (id)) GROUP BY outcome""",
    "stash_listing": f"WITH {_LISTING} SELECT * FROM ls",
    "stash_collectable": f"WITH {_LISTING} SELECT id12, created_at FROM ls WHERE n_refs = 0 AND epoch((SELECT max(returned_at) FROM results)) - epoch(created_at) >= 2592000",
    "stash_search": f"""WITH q AS (SELECT t.key AS key, max(t.weight) AS weight FROM (SELECT unnest({_terms(f"'{SEARCH}'")}) AS t) GROUP BY 1 HAVING max(t.weight) > 0),
        r AS (SELECT result_id, max(text) AS text FROM results WHERE text IS NOT NULL GROUP BY result_id), h AS (SELECT DISTINCT result_id, t.key AS key FROM (SELECT result_id, unnest({_terms('text')}) AS t FROM r)),
        m AS (SELECT h.*, weight, count(*) OVER (PARTITION BY key) AS df FROM h JOIN q USING (key)), s AS (SELECT result_id, round(sum(weight / df), 9) AS score, string_agg(key, ',' ORDER BY -weight, key) AS terms FROM m GROUP BY result_id)
        SELECT *, CAST(row_number() OVER (ORDER BY score DESC, result_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, result_id LIMIT 10""",
    "prompt_hints": f"""WITH pm AS (SELECT session_id, message_index, max(text) AS text FROM messages WHERE session_id IS NOT NULL AND message_index IS NOT NULL AND lower(trim(role)) = 'user' GROUP BY ALL),
        p AS (SELECT session_id, message_index, t.key AS key, max(t.weight) AS weight FROM (SELECT session_id, message_index, unnest({_terms('text')}) AS t FROM pm) GROUP BY ALL HAVING max(t.weight) > 0),
        r AS (SELECT session_id, result_id, max(text) AS text FROM results WHERE session_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL), h AS (SELECT DISTINCT session_id, result_id, t.key AS key FROM (SELECT session_id, result_id, unnest({_terms('text')}) AS t FROM r)),
        d AS (SELECT *, count(*) OVER (PARTITION BY session_id, key) AS df FROM h),
        s AS (SELECT p.session_id, message_index, result_id, round(sum(weight / df), 9) AS score, max(weight) AS top FROM p JOIN d ON p.session_id = d.session_id AND p.key = d.key GROUP BY ALL),
        k AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, coalesce(lead(score) OVER w, 0) AS nxt, score >= 3 AND top >= 2 AS fits FROM s WINDOW w AS (PARTITION BY session_id, message_index ORDER BY score DESC, result_id)),
        n AS (SELECT session_id, message_index, CASE WHEN bool_and(fits) FILTER (rank <= 2) AND coalesce(max(score >= 1.5 * nxt) FILTER (rank = 2), false) THEN 2 WHEN bool_and(fits) FILTER (rank = 1) AND max(score >= 1.5 * nxt) FILTER (rank = 1) THEN 1 ELSE 0 END AS n FROM k GROUP BY ALL)
        SELECT k.session_id, k.message_index, result_id, score, rank FROM k JOIN n ON k.session_id = n.session_id AND k.message_index = n.message_index WHERE rank <= n""",
    "lean_notes": """WITH r AS (SELECT result_id, max(text) AS text FROM results WHERE result_id IS NOT NULL AND text IS NOT NULL GROUP BY result_id), l AS (SELECT *, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM r),
        f AS (SELECT *, list_filter(list_transform(list_concat(ls[:4], ls[greatest(1, len(ls) - 2):]), lambda x: regexp_extract(trim(x), '^(?:Process exited with code|Exit code:?|exit code:?)\\s*(-?\\d+)\\b', 1)), lambda x: x <> '') AS codes,
          list_transform(list_concat(regexp_extract_all(text, '(?m)^(?:FAILED|ERROR) (\\S+::\\S+)', 1), regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\\b', 1)), lambda x: x[:60]) AS ids,
          list_filter(list_transform(ls, lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(?:Chunk ID|Wall time|Process exited with code|Process running with session ID|Original token count)\\b') AND x <> 'Output:' AND x <> '') AS body FROM l)
        SELECT result_id, codes[1] AS exit_code, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i)[:2], ', ') AS named, CASE WHEN len(body[1]) > 60 THEN body[1][:60] || '…' ELSE coalesce(body[1], '') END AS opening FROM f""",
    "disk_states": f"""WITH {_VIEWS}, j AS (SELECT v.session_id || ':' || v.call_id || ':' || v.message_index AS id, {_SPLIT.format('v.text')} AS shown, {_SPLIT.format('f.content')} AS disk FROM v JOIN files f ON f.path = v.path),
        k AS (SELECT *, list_transform(shown, lambda x: TRY_CAST(regexp_extract(x, '^\\s*([1-9][0-9]*)(?:\\t|→)(.*)$', 1) AS INTEGER)) AS n, list_transform(shown, lambda x: regexp_extract(x, '(?s)^\\s*([1-9][0-9]*)(?:\\t|→)(.*)$', 2)) AS body FROM j),
        o AS (SELECT *, len(n) > 0 AND len(list_filter(n, lambda x, i: x IS NULL OR n[1] IS NULL OR x - i <> n[1] - 1)) = 0 AS numbered FROM k),
        d AS (SELECT *, CASE WHEN numbered THEN len(list_filter(n, lambda x, i: disk[x] IS DISTINCT FROM body[i])) END AS differ FROM o)
        SELECT id, CASE WHEN CASE WHEN numbered THEN differ = 0 WHEN len(shown) = 0 THEN len(disk) = 0 ELSE contains(chr(10) || array_to_string(disk, chr(10)) || chr(10), chr(10) || array_to_string(shown, chr(10)) || chr(10)) END THEN 'unchanged' ELSE 'changed' END AS state,
        CASE WHEN numbered THEN 'numbered' ELSE 'lines' END AS compared_as, CAST(len(shown) AS INTEGER) AS lines_compared, CAST(differ AS INTEGER) AS lines_differ FROM d""",
    "changed_since": f'WITH {_VIEWS} SELECT DISTINCT v.path AS path, sha256(v.text) AS "then", CASE WHEN v.text = f.content THEN \'same\' ELSE \'changed\' END AS state FROM v JOIN files f ON f.path = v.path',
}
