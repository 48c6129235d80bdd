"""Transcript operators on calls, results, messages and reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X
from lakeweave.operators import transcript as R
from lakeweave.sources.tables import table


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


def _stream(spark, folder):
    return R.stream(_t(spark, folder, "calls"), _t(spark, folder, "results"))


def _last(spark, folder):
    return _t(spark, folder, "messages").groupBy("session_id").agg(F.max("message_index").alias("last_index"))


def _rules(spark, folder):
    return R.rules(_stream(spark, folder), _last(spark, folder))


def call_pairs(spark, folder):
    c = R.calls_once(_t(spark, folder, "calls")).select("session_id", "call_id", "message_index", "pos", X.tool_name(F.col("tool")).alias("tool"))
    r = R.results_last(_t(spark, folder, "results")).select("session_id", "call_id", "result_id", "result_at", F.length("text").alias("n_chars"))
    return c.join(r, ["session_id", "call_id"], "left")


def orphans(spark, folder):
    r = _t(spark, folder, "results").filter("session_id is not null").select("result_id", "session_id", "call_id").distinct()
    return r.join(_t(spark, folder, "calls").select("session_id", "call_id"), ["session_id", "call_id"], "left_anti")


def supersession(spark, folder):
    return R.superseded(_stream(spark, folder)).filter("superseded_by is not null").select("session_id", "call_id", "seq", "superseded_by")


def protections(spark, folder):
    return R.protected(_stream(spark, folder)).filter("protection is not null").select("session_id", "call_id", "seq", "protection")


def apply_rules(spark, folder):
    out = R.compacted(_stream(spark, folder), _rules(spark, folder), _t(spark, folder, "results"))
    return out.select("session_id", "call_id", "action", F.sha2("text", 256).alias("digest"))


def stash(spark, folder):
    return R.stash_put(_t(spark, folder, "results"))


def stash_recall(spark, folder):
    s = R.stash_put(_t(spark, folder, "results"))
    wanted = _t(spark, folder, "results").filter("text is not null and result_id % 100 = 0").select(F.substring(F.sha2("text", 256), 1, 12).alias("id12"))
    return R.recall(s, wanted)


def stash_unreferenced(spark, folder):
    return R.unreferenced(R.stash_put(_t(spark, folder, "results")), _t(spark, folder, "messages").select("text")).select("sha256", "n_bytes")


def result_lines(spark, folder):
    return R.line_range(_t(spark, folder, "results"), 2, 4)


def search_hints(spark, folder):
    m = _t(spark, folder, "messages").filter("session_id is not null and text is not null and lower(trim(role)) = 'user' and trim(text) <> ''")
    return R.hints(_t(spark, folder, "results"), m.select("session_id", "text"))


def handoff(spark, folder):
    return R.handoff(_stream(spark, folder), _t(spark, folder, "messages"))


def replay(spark, folder):
    """Messages as items: a user's message is a request, a system's a boundary."""
    m = _t(spark, folder, "messages").filter("session_id is not null").groupBy("session_id", F.col("message_index").alias("seq")).agg(F.max(X.token_estimate(F.col("text"))).alias("tokens"), F.max(F.lower(F.trim(F.coalesce("role", F.lit(""))))).alias("role"))
    e = m.select("session_id", "seq", "tokens", (F.col("role") == "user").alias("is_request"), (F.col("role") == "system").alias("is_boundary"))
    return R.replay(e).groupBy("session_id", "segment").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"), F.sum("charged").alias("charged"))


def rereads(spark, folder):
    return R.rereads(_stream(spark, folder))


def top_tools(spark, folder):
    return R.top_with_rest(_stream(spark, folder).filter("tokens is not null"), "tool", "tokens", 4)


def largest_outputs(spark, folder):
    r = _t(spark, folder, "results").filter("text is not null").groupBy("result_id").agg(F.max(F.length("text")).alias("n_chars"))
    return r.orderBy(F.desc("n_chars"), "result_id").limit(20)


def cache_states(spark, folder):
    return R.cache_states(_t(spark, folder, "messages"))


def session_summary(spark, folder):
    return R.session_summary(_stream(spark, folder), _rules(spark, folder))


def usage(spark, folder):
    return R.usage_summary(_t(spark, folder, "reports"))


def fit(spark, folder):
    return R.token_fit(_t(spark, folder, "reports"))


def rules(spark, folder):
    return _rules(spark, folder).drop("n_chars", "tokens")


def pointers(spark, folder):
    return R.pointers(_stream(spark, folder))


def repeated_ids(spark, folder):
    return R.repeated_ids(_t(spark, folder, "calls"))


QUERIES = {
    "call_result_pairs": call_pairs, "orphan_results": orphans, "repeated_call_ids": repeated_ids, "superseded_calls": supersession, "latest_protections": protections,
    "transcript_rules": rules, "transcript_apply": apply_rules, "identical_output_pointers": pointers, "session_summary": session_summary,
    "stash_put": stash, "stash_recall": stash_recall, "stash_unreferenced": stash_unreferenced, "result_line_range": result_lines, "stash_hints": search_hints, "handoff_packet": handoff,
    "replay_accounting": replay, "reread_tokens": rereads, "top_tools_by_tokens": top_tools, "largest_outputs": largest_outputs, "idle_cache_state": cache_states, "usage_summary": usage, "token_fit": fit,
}

# --- SQL twins ------------------------------------------------------------------------------


def _lst(values) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


def _tool(t: str) -> str:
    return f"lower(regexp_replace(trim({t}), '^mcp__.*?__', ''))"


def _est(t: str) -> str:
    from lakeweave.plans.document_queries import _est as est

    return est(t)


def _member(name: str) -> str:
    return f"CASE WHEN json_valid(input_json) AND json_type(input_json, '$.{name}') = 'VARCHAR' THEN json_extract_string(input_json, '$.{name}') END"


_COMPARABLE = "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^(?:Chunk ID|Wall time|Original token count|Process running with session ID|Process exited with code)\\b.*\\n?', '', 'g')"
_C1 = "c1 AS (SELECT session_id, message_index, pos, call_id, min(tool) AS tool, min(input_json) AS input_json, min(path) AS path, min(command) AS command FROM calls WHERE session_id IS NOT NULL AND call_id IS NOT NULL GROUP BY ALL)"
_R1 = "r1 AS (SELECT session_id, call_id, result_id, message_index AS result_at, text, is_error FROM results WHERE session_id IS NOT NULL AND call_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY message_index DESC, pos DESC, result_id DESC) = 1)"
_PARTIAL = " OR ".join(f"json_extract(input_json, '$.{k}') IS NOT NULL" for k in ("offset", "limit", "pages"))
_STREAM = f"""{_C1}, {_R1},
c2 AS (SELECT session_id, message_index, pos, call_id, {_tool("tool")} AS tool, coalesce(path, {_member("file_path")}, {_member("notebook_path")}, {_member("path")}) AS path, coalesce(command, {_member("command")}, {_member("cmd")}) AS command,
  CASE WHEN json_valid(input_json) THEN ({_PARTIAL}) ELSE false END AS partial, sha256(coalesce(input_json, '')) AS input_digest FROM c1),
r2 AS (SELECT session_id, call_id, result_id, len(text) AS n_chars, sha256({_COMPARABLE}) AS digest, coalesce(is_error, false) AS is_error, regexp_matches(text, '{fixed.ERROR}') AS looks_failed, CASE WHEN text IS NULL THEN 0 ELSE {_est("text")} END AS tokens FROM r1),
s0 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index, pos, call_id) AS seq, coalesce(is_error, false) AS failed, tool IN {_lst(fixed.FILE_VIEW_TOOLS + fixed.EDIT_TOOLS)} AND path IS NOT NULL AS is_file FROM c2 LEFT JOIN r2 USING (session_id, call_id)),
s AS (SELECT *, CASE WHEN is_file THEN 'file:' || path WHEN tool = 'bash' AND command IS NOT NULL THEN 'bash:' || command ELSE concat_ws(':', 'call', tool, input_digest) END AS key,
  coalesce(tool IN {_lst(fixed.FILE_VIEW_TOOLS)} AND NOT partial AND result_id IS NOT NULL AND NOT failed AND is_file, false) AS whole FROM s0)"""
_SUP = """sup AS (SELECT *, CASE WHEN is_file THEN first_value(CASE WHEN whole THEN call_id END IGNORE NULLS) OVER (PARTITION BY session_id, key ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  WHEN lead(digest) OVER (PARTITION BY session_id, key ORDER BY seq) = digest THEN lead(call_id) OVER (PARTITION BY session_id, key ORDER BY seq) END AS superseded_by FROM s)"""


def _latest(cond: str) -> str:
    return f"coalesce(seq = max(CASE WHEN {cond} THEN seq END) OVER (PARTITION BY session_id), false)"


_GIT = " OR ".join(_latest(f"tool = 'bash' AND regexp_matches(command, '\\bgit\\s+{x}\\b')") for x in ("status", "diff", "log"))
_PROT = f"""pe AS (SELECT *, CASE WHEN bool_or(failed) OVER (PARTITION BY session_id) THEN failed ELSE coalesce(command IS NOT NULL AND looks_failed, false) END AS error FROM sup),
pl AS (SELECT *, max(CASE WHEN error THEN seq END) OVER (PARTITION BY session_id) AS last_error FROM pe),
prot AS (SELECT *, CASE WHEN seq = last_error THEN 'latest_error_result' WHEN seq = last_error - 1 THEN 'call_before_latest_error' WHEN {_GIT} THEN 'latest_git_state'
  WHEN {_latest(f"tool IN {_lst(fixed.EDIT_TOOLS)}")} THEN 'latest_artifact_edit' WHEN {_latest("result_id IS NOT NULL")} THEN 'latest_tool_result' END AS protection FROM pl)"""
_RULES = f"""{_STREAM}, {_SUP}, {_PROT},
li AS (SELECT session_id, max(message_index) AS last_index FROM messages GROUP BY session_id),
ra AS (SELECT p.*, coalesce(last_index, message_index) - message_index AS age,
  coalesce(path IS NOT NULL AND bool_or(tool IN {_lst(fixed.EDIT_TOOLS)}) OVER (PARTITION BY session_id, path ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS edited_later FROM prot p LEFT JOIN li USING (session_id)),
rw AS (SELECT *, CASE WHEN message_index = 0 OR age < {fixed.PRESERVE_RECENT} THEN 'keep:pinned' WHEN protection IS NOT NULL THEN 'keep:' || protection WHEN superseded_by IS NOT NULL THEN 'drop:superseded_by_later_call:' || superseded_by
  WHEN tool IN {_lst(fixed.READ_TOOLS)} AND NOT error AND age > {fixed.STALE_AFTER} THEN 'drop:stale_read_far_from_recent_work'
  WHEN n_chars > {fixed.LARGE_RESULT} AND age > {fixed.STALE_AFTER} AND NOT error AND NOT edited_later THEN 'trim:large_old_output_trimmed' ELSE 'keep:kept_default' END AS w FROM ra WHERE result_id IS NOT NULL),
rules AS (SELECT session_id, call_id, seq, w[:4] AS action, w[6:] AS reason, n_chars, tokens FROM rw)"""
_LABEL = "CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE printf('%.1f KB', round_even(strlen(text) / 1024, 1)) END"
_NOTE = f"'[removed: ' || (len(text) - len(replace(text, chr(10), '')) + 1) || ' lines, ' || {_LABEL} || ', id ' || sha256(text)[:12] || ']'"
_PUT = "put AS (SELECT sha256(text) AS sha256, max(strlen(text)) AS n_bytes, count(DISTINCT session_id) AS n_sessions, min(returned_at) AS first_at FROM results WHERE len(text) >= 400 GROUP BY 1)"
_SEARCH = "list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_./:-]*'), lambda w: lower(regexp_replace(w, '[./:-]+$', ''))), lambda w: len(w) >= 4))"

SQL = {
    "call_result_pairs": f"WITH {_C1}, {_R1} SELECT session_id, call_id, message_index, pos, {_tool('tool')} AS tool, result_id, result_at, len(text) AS n_chars FROM c1 LEFT JOIN r1 USING (session_id, call_id)",
    "orphan_results": "SELECT DISTINCT result_id, session_id, call_id FROM results r WHERE session_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.session_id = r.session_id AND c.call_id = r.call_id)",
    "repeated_call_ids": f"WITH {_C1} SELECT session_id, call_id, count(*) AS n FROM c1 GROUP BY session_id, call_id HAVING count(*) > 1",
    "superseded_calls": f"WITH {_STREAM}, {_SUP} SELECT session_id, call_id, seq, superseded_by FROM sup WHERE superseded_by IS NOT NULL",
    "latest_protections": f"WITH {_STREAM}, {_SUP}, {_PROT} SELECT session_id, call_id, seq, protection FROM prot WHERE protection IS NOT NULL",
    "transcript_rules": f"WITH {_RULES} SELECT session_id, call_id, seq, action, reason FROM rules",
    "transcript_apply": f"WITH {_RULES} SELECT session_id, call_id, action, sha256(CASE WHEN action = 'trim' THEN text[:{fixed.TRIM_HEAD}] || chr(10) || {_NOTE} || chr(10) || right(text, {fixed.TRIM_TAIL}) ELSE text END) AS digest FROM rules JOIN r1 USING (session_id, call_id) WHERE action <> 'drop'",
    "identical_output_pointers": f"""WITH {_STREAM}, p AS (SELECT *, last_value(call_id) OVER w AS points_to, last_value(seq) OVER w AS last_seq FROM s WHERE result_id IS NOT NULL AND n_chars > 0
        WINDOW w AS (PARTITION BY session_id, digest, failed ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT session_id, call_id, points_to, n_chars - len('[identical output kept at ]' || points_to) AS saved_chars FROM p WHERE last_seq <> seq AND n_chars - len('[identical output kept at ]' || points_to) > 0""",
    "session_summary": f"""WITH {_RULES}, t AS (SELECT session_id, count(*) AS n_calls, count(result_id) AS n_results, sum(coalesce(tokens, 0)) AS tokens FROM s GROUP BY session_id), g AS (SELECT session_id, sum(CASE WHEN action = 'drop' THEN coalesce(tokens, 0) ELSE 0 END) AS dropped_tokens FROM rules GROUP BY session_id)
        SELECT session_id, n_calls, n_results, tokens, coalesce(dropped_tokens, 0) AS dropped_tokens, CASE WHEN tokens > 0 THEN round(coalesce(dropped_tokens, 0) / tokens, 4) ELSE 0.0 END AS share FROM t LEFT JOIN g USING (session_id)""",
    "stash_put": f"WITH {_PUT} SELECT * FROM put",
    "stash_recall": f"""WITH {_PUT}, b AS (SELECT sha256[:12] AS id12, count(*) AS n, min(sha256) AS sha256 FROM put GROUP BY 1), w AS (SELECT DISTINCT sha256(text)[:12] AS id12 FROM results WHERE text IS NOT NULL AND result_id % 100 = 0)
        SELECT id12, CASE WHEN n = 1 THEN sha256 END AS sha256, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS outcome FROM w LEFT JOIN b USING (id12)""",
    "stash_unreferenced": f"WITH {_PUT}, ids AS (SELECT unnest(regexp_extract_all(text, 'recall ([0-9a-f]{{12}})', 1)) AS id12 FROM messages) SELECT sha256, n_bytes FROM put WHERE sha256[:12] NOT IN (SELECT id12 FROM ids)",
    "result_line_range": "SELECT result_id, coalesce(array_to_string(string_split(max(text), chr(10))[2:4], chr(10)), '') AS part FROM results WHERE text IS NOT NULL GROUP BY result_id",
    "stash_hints": f"""WITH pm AS (SELECT session_id, text FROM messages WHERE session_id IS NOT NULL AND text IS NOT NULL AND lower(trim(role)) = 'user' AND trim(text) <> ''),
        q0 AS (SELECT DISTINCT session_id, unnest({_SEARCH}) AS term FROM pm), q AS (SELECT *, CASE WHEN regexp_matches(term, '[0-9_./:-]') THEN 3 WHEN len(term) >= 8 THEN 2 ELSE 1 END AS weight FROM q0 WHERE term NOT IN {_lst(fixed.STOPWORDS)}),
        r AS (SELECT session_id, result_id, max(text) AS text FROM results WHERE session_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL), h0 AS (SELECT session_id, result_id, unnest({_SEARCH}) AS term FROM r), h AS (SELECT * FROM h0 JOIN q USING (session_id, term)),
        sc AS (SELECT session_id, result_id, round(sum(weight / df), 6) AS score, max(weight) AS top FROM (SELECT *, count(*) OVER (PARTITION BY session_id, term) AS df FROM h) GROUP BY ALL)
        SELECT session_id, result_id, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, result_id) AS rank FROM sc WHERE score >= 3 AND top >= 2 QUALIFY rank <= 2""",
    "handoff_packet": f"""WITH {_STREAM}, m0 AS (SELECT session_id, message_index, max(text) AS text FROM messages WHERE session_id IS NOT NULL AND lower(trim(role)) = 'user' AND trim(text) <> '' GROUP BY ALL),
        m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_index) AS up, row_number() OVER (PARTITION BY session_id ORDER BY message_index DESC) AS down FROM m0),
        f0 AS (SELECT session_id, CASE WHEN tool IN {_lst(fixed.EDIT_TOOLS)} THEN 'edited' WHEN tool = 'read' THEN 'read' END AS kind, path, seq FROM s WHERE path IS NOT NULL), f1 AS (SELECT session_id, kind, path, max(seq) AS place FROM f0 WHERE kind IS NOT NULL GROUP BY ALL), f AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY place DESC, path) <= 5)
        SELECT session_id, CASE WHEN up = 1 THEN 'first_prompt' ELSE 'last_prompt' END AS kind, message_index AS place, text AS value FROM m WHERE up = 1 OR down <= 3
        UNION ALL SELECT session_id, kind, place, path FROM f UNION ALL (SELECT session_id, 'last_error', seq, call_id FROM s WHERE failed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1)""",
    "replay_accounting": f"""WITH m AS (SELECT session_id, message_index AS seq, max({_est("text")}) AS tokens, max(lower(trim(coalesce(role, '')))) AS role FROM messages WHERE session_id IS NOT NULL GROUP BY ALL),
        e AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS segment FROM m),
        c AS (SELECT *, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, segment ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) * tokens AS charged FROM e)
        SELECT session_id, segment, count(*) AS n_items, sum(tokens) AS tokens, sum(charged) AS charged FROM c GROUP BY ALL""",
    "reread_tokens": f"WITH {_STREAM} SELECT session_id, count(*) AS repeated_outputs, sum(tokens) AS repeated_tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_id, digest ORDER BY seq) AS nth FROM s WHERE tokens >= {fixed.REREAD_MIN_TOKENS}) WHERE nth > 1 GROUP BY session_id",
    "top_tools_by_tokens": f"""WITH {_STREAM}, t AS (SELECT coalesce(tool, 'unknown') AS label, sum(tokens) AS total FROM s WHERE tokens IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY total DESC, label) AS r FROM t)
        SELECT label, total FROM k WHERE r <= 4 UNION ALL SELECT '(other)', sum(total) FROM k WHERE r > 4 HAVING count(*) > 0""",
    "largest_outputs": "SELECT result_id, max(len(text)) AS n_chars FROM results WHERE text IS NOT NULL GROUP BY result_id ORDER BY n_chars DESC, result_id LIMIT 20",
    "idle_cache_state": """WITH m AS (SELECT session_id, message_index, min(sent_at) AS sent FROM messages WHERE session_id IS NOT NULL GROUP BY ALL), g AS (SELECT (epoch_us(sent) - epoch_us(lag(sent) OVER (PARTITION BY session_id ORDER BY message_index))) / 1e6 AS idle FROM m)
        SELECT CASE WHEN idle IS NULL THEN 'unknown' WHEN idle < 0 THEN 'warm' WHEN idle >= 300 THEN 'cold' ELSE 'warm' END AS state, CASE WHEN idle IS NULL THEN 'missing_timestamp' WHEN idle < 0 THEN 'clock_skew' WHEN idle >= 300 THEN 'idle_past_ttl' ELSE 'idle_within_ttl' END AS reason,
        CASE WHEN idle IS NULL OR idle < 0 THEN 'unknown' WHEN idle < 300 THEN '<5m' WHEN idle < 3600 THEN '5m-1h' WHEN idle < 7200 THEN '1h-2h' WHEN idle < 28800 THEN '2h-8h' ELSE '>8h' END AS bucket, count(*) AS n FROM g GROUP BY ALL""",
    "usage_summary": """WITH r AS (SELECT DISTINCT ON (report_id) session_id, coalesce(mode, 'other') AS mode, coalesce(provider_used, 'other') AS provider, reduction_ratio, tokens_before, created_at FROM reports WHERE reduction_ratio IS NOT NULL)
        SELECT mode, provider, count(*) AS n, round(quantile_cont(reduction_ratio, 0.1), 6) AS p10, round(quantile_cont(reduction_ratio, 0.5), 6) AS p50, round(quantile_cont(reduction_ratio, 0.9), 6) AS p90, round(sum(tokens_before), 2) AS tokens_before,
        count(*) FILTER (reduction_ratio < 0.25) AS gate, count(DISTINCT session_id) AS n_sessions, count(DISTINCT created_at::DATE) AS active_days FROM r GROUP BY GROUPING SETS ((mode, provider), (mode), ())""",
    "token_fit": "SELECT mode, count(*) AS n, round(regr_slope(tokens_after, tokens_before), 6) AS slope, round(regr_intercept(tokens_after, tokens_before), 3) AS intercept FROM (SELECT DISTINCT ON (report_id) * FROM reports WHERE tokens_before IS NOT NULL AND tokens_after IS NOT NULL) GROUP BY mode HAVING count(*) >= 10",
}
