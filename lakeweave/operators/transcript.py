"""Operators over the calls of agent sessions: pairing, supersession, pointers, compaction, stash.

The unit is the call with its result, in the order of its session. Windows are by session
or by (session, key); texts stay out of them, only hashes and lengths go in, and texts are
joined back by what was decided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X

NOTE_LEAST = 60


def _member(name: str) -> Column:
    """A text member of the parsed input ``v``, null where the input is no JSON object or the member no text."""
    v = F.col("v")
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def calls_once(calls: DataFrame) -> DataFrame:
    """One row per (session, message_index, pos, call_id): late and repeated rows count once."""
    c = calls.filter(F.col("session_id").isNotNull() & F.col("call_id").isNotNull())
    return c.groupBy("session_id", "message_index", "pos", "call_id").agg(*[F.min(x).alias(x) for x in ("tool", "input_json", "path", "command")])


def results_last(results: DataFrame) -> DataFrame:
    """(session_id, call_id, result_id, text, is_error): the last result of an id wins."""
    r = results.filter(F.col("session_id").isNotNull() & F.col("call_id").isNotNull())
    last = F.max(F.struct("message_index", "pos", "result_id", F.col("message_index").alias("result_at"), "text", "is_error")).alias("r")
    return r.groupBy("session_id", "call_id").agg(last).select("session_id", "call_id", "r.result_id", "r.result_at", "r.text", "r.is_error")


def comparable(text: Column) -> Column:
    """A result without the header lines that differ from run to run."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(t, r"(?m)^(?:Chunk ID|Wall time|Original token count|Process running with session ID|Process exited with code)\b.*\n?", "")


def stream(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The calls of every session in order, with their keys and what their results are.

    key is what a later call must share to replace this one: the file of views and edits, the
    command of a shell, else tool and input. whole marks a successful view of a whole file.
    """
    # parsed once for all that is asked of it
    c = calls_once(calls).withColumn("v", F.try_parse_json("input_json"))
    path = F.coalesce("path", _member("file_path"), _member("notebook_path"), _member("path"))
    command = F.coalesce("command", _member("command"), _member("cmd"))
    partial = reduce(lambda a, b: a | b, [F.try_variant_get("v", f"$.{k}", "variant").isNotNull() for k in ("offset", "limit", "pages")])
    c = c.select("session_id", "message_index", "pos", "call_id", X.tool_name(F.col("tool")).alias("tool"), path.alias("path"), command.alias("command"), F.coalesce(partial, F.lit(False)).alias("partial"), F.sha2(F.coalesce("input_json", F.lit("")), 256).alias("input_digest"))
    r = results_last(results).select("session_id", "call_id", "result_id", F.length("text").alias("n_chars"), F.sha2(comparable(F.col("text")), 256).alias("digest"), F.coalesce("is_error", F.lit(False)).alias("is_error"), F.col("text").rlike(fixed.ERROR).alias("looks_failed"), X.token_estimate(F.col("text")).alias("tokens"))
    s = c.join(r, ["session_id", "call_id"], "left")
    by = W.partitionBy("session_id").orderBy("message_index", "pos", "call_id")
    s = s.withColumn("seq", F.row_number().over(by))
    is_file = F.col("tool").isin(*fixed.FILE_VIEW_TOOLS, *fixed.EDIT_TOOLS) & F.col("path").isNotNull()
    key = F.when(is_file, F.concat(F.lit("file:"), "path")).when((F.col("tool") == "bash") & F.col("command").isNotNull(), F.concat(F.lit("bash:"), "command")).otherwise(F.concat_ws(":", F.lit("call"), "tool", "input_digest"))
    failed = F.coalesce("is_error", F.lit(False))
    s = s.withColumn("key", key).withColumn("is_file", is_file).withColumn("failed", failed)
    whole = F.col("tool").isin(*fixed.FILE_VIEW_TOOLS) & ~F.col("partial") & F.col("result_id").isNotNull() & ~F.col("failed")
    return s.withColumn("whole", F.coalesce(whole & F.col("is_file"), F.lit(False)))


def superseded(s: DataFrame) -> DataFrame:
    """The stream with ``superseded_by``: the later call that makes a call's output stale, or null.

    A file's view or edit is replaced by the next whole view of the file; any other call by
    the next call of its key, if that gave the same output.
    """
    w = W.partitionBy("session_id", "key").orderBy("seq")
    later = w.rowsBetween(1, W.unboundedFollowing)
    next_view = F.first(F.when(F.col("whole"), F.col("call_id")), ignorenulls=True).over(later)
    rerun = F.when(F.lead("digest").over(w) == F.col("digest"), F.lead("call_id").over(w))
    return s.withColumn("superseded_by", F.when(F.col("is_file"), next_view).otherwise(rerun))


def protected(s: DataFrame) -> DataFrame:
    """The stream with ``protection``: the first rule by which a call must stay, or null.

    The latest of each class in a session: an error and the call before it, git status, diff
    and log, an edit, a result.
    """
    w = W.partitionBy("session_id")
    latest = lambda cond: F.col("seq") == F.max(F.when(cond, F.col("seq"))).over(w)
    flagged = F.bool_or("failed").over(w)
    s = s.withColumn("error", F.when(flagged, F.col("failed")).otherwise(F.coalesce(F.col("command").isNotNull() & F.col("looks_failed"), F.lit(False))))
    last_error = F.max(F.when(F.col("error"), F.col("seq"))).over(w)
    git = reduce(lambda a, b: a | b, [latest((F.col("tool") == "bash") & F.col("command").rlike(rf"\bgit\s+{x}\b")) for x in ("status", "diff", "log")])
    rule = (
        F.when(F.col("seq") == last_error, "latest_error_result")
        .when(F.col("seq") == last_error - 1, "call_before_latest_error")
        .when(F.coalesce(git, F.lit(False)), "latest_git_state")
        .when(latest(F.col("tool").isin(*fixed.EDIT_TOOLS)), "latest_artifact_edit")
        .when(latest(F.col("result_id").isNotNull()), "latest_tool_result")
    )
    return s.withColumn("protection", rule)


def rules(s: DataFrame, last_index: DataFrame) -> DataFrame:
    """(session_id, call_id, seq, action, reason): keep, drop or trim of every call with a result.

    last_index: (session_id, last_index) of the messages. First rule that holds: the first
    and the newest six messages stay; protected; superseded; a read more than 40 messages
    back; a long old output is trimmed unless it is an error or its file is edited later.
    """
    p = protected(superseded(s)).join(last_index, "session_id", "left")
    later = W.partitionBy("session_id", "path").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    edited = F.coalesce(F.col("path").isNotNull() & F.bool_or(F.col("tool").isin(*fixed.EDIT_TOOLS)).over(later), F.lit(False))
    age = F.coalesce(F.col("last_index"), F.col("message_index")) - F.col("message_index")
    p = p.withColumn("edited_later", edited).withColumn("age", age).filter("result_id is not null")
    stale = F.col("tool").isin(*fixed.READ_TOOLS) & ~F.col("error") & (F.col("age") > fixed.STALE_AFTER)
    trim = (F.col("n_chars") > fixed.LARGE_RESULT) & (F.col("age") > fixed.STALE_AFTER) & ~F.col("error") & ~F.col("edited_later")
    what = (
        F.when((F.col("message_index") == 0) | (F.col("age") < fixed.PRESERVE_RECENT), "keep:pinned")
        .when(F.col("protection").isNotNull(), F.concat(F.lit("keep:"), "protection"))
        .when(F.col("superseded_by").isNotNull(), F.concat(F.lit("drop:superseded_by_later_call:"), "superseded_by"))
        .when(stale, "drop:stale_read_far_from_recent_work")
        .when(trim, "trim:large_old_output_trimmed")
        .otherwise("keep:kept_default")
    )
    return p.withColumn("w", what).select("session_id", "call_id", "seq", F.substring("w", 1, 4).alias("action"), F.expr("substring(w, 6)").alias("reason"), "n_chars", "tokens")


def repeated_ids(calls: DataFrame) -> DataFrame:
    """(session_id, call_id, n): ids that name several calls of a session; such calls are never touched."""
    return calls_once(calls).groupBy("session_id", "call_id").agg(F.count("*").alias("n")).filter("n > 1")


def pointers(s: DataFrame) -> DataFrame:
    """(session_id, call_id, points_to, saved_chars): results whose output stands again later.

    The pointer goes to the last result with the same comparable lines and error flag, which
    stays itself; it is used only where its note is shorter than the output.
    """
    w = W.partitionBy("session_id", "digest", "failed")
    last = F.max(F.struct("seq", "call_id")).over(w)
    p = s.filter("result_id is not null and n_chars > 0").withColumn("last", last)
    note = F.length(F.concat(F.lit("[identical output kept at ]"), "last.call_id"))
    p = p.filter("last.seq <> seq").withColumn("saved_chars", F.col("n_chars") - note)
    return p.filter("saved_chars > 0").select("session_id", "call_id", F.col("last.call_id").alias("points_to"), "saved_chars")


def compacted(s: DataFrame, decisions: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, call_id, text) after the decisions: dropped calls are gone, trimmed outputs keep head and tail."""
    kept = decisions.filter("action <> 'drop'").select("session_id", "call_id", "action")
    r = results_last(results).select("session_id", "call_id", "text").join(kept, ["session_id", "call_id"])
    note = F.concat(F.lit("\n"), X.stash_note(F.col("text")), F.lit("\n"))
    trimmed = F.concat(F.substring("text", 1, fixed.TRIM_HEAD), note, F.expr(f"right(text, {fixed.TRIM_TAIL})"))
    return r.select("session_id", "call_id", "action", F.when(F.col("action") == "trim", trimmed).otherwise(F.col("text")).alias("text"))


def session_summary(s: DataFrame, decisions: DataFrame) -> DataFrame:
    """(session_id, n_calls, n_results, tokens, dropped_tokens, share): what the rules remove from each session."""
    total = s.groupBy("session_id").agg(F.count("*").alias("n_calls"), F.count("result_id").alias("n_results"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
    gone = decisions.groupBy("session_id").agg(F.sum(F.when(F.col("action") == "drop", F.coalesce("tokens", F.lit(0))).otherwise(0)).alias("dropped_tokens"))
    out = total.join(gone, "session_id", "left").withColumn("dropped_tokens", F.coalesce("dropped_tokens", F.lit(0)))
    return out.withColumn("share", F.when(F.col("tokens") > 0, F.round(F.col("dropped_tokens") / F.col("tokens"), 4)).otherwise(F.lit(0.0)))


# --- stash: outputs kept elsewhere under their hash ----------------------------------------


def stash_put(results: DataFrame, least_chars: int = 400) -> DataFrame:
    """(sha256, n_bytes, n_sessions, first_at): one blob per text, whoever put it, at its first time."""
    r = results.filter(F.length("text") >= least_chars).select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("n_bytes"), "session_id", "returned_at")
    return r.groupBy("sha256").agg(F.max("n_bytes").alias("n_bytes"), F.count_distinct("session_id").alias("n_sessions"), F.min("returned_at").alias("first_at"))


def recall(stash: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id12, sha256, outcome) for 12-digit ids: ok, missing or ambiguous."""
    by = stash.groupBy(F.substring("sha256", 1, 12).alias("id12")).agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"))
    out = wanted.select("id12").distinct().join(by, "id12", "left")
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return out.select("id12", F.when(outcome == "ok", F.col("sha256")).alias("sha256"), outcome.alias("outcome"))


def unreferenced(stash: DataFrame, texts: DataFrame) -> DataFrame:
    """Blobs that no text names by its first 12 digits (``recall <id>``)."""
    ids = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"recall ([0-9a-f]{12})"), 1))).alias("id12"))
    return stash.withColumn("id12", F.substring("sha256", 1, 12)).join(ids, "id12", "left_anti").drop("id12")


def line_range(results: DataFrame, first: int, last: int) -> DataFrame:
    """(result_id, part): lines first..last (from 1) of every result, blanks where they end before."""
    r = results.filter(F.col("text").isNotNull()).groupBy("result_id").agg(F.max("text").alias("text"))
    return r.select("result_id", F.array_join(F.slice(F.split("text", "\n"), first, last - first + 1), "\n").alias("part"))


def search_terms(text: Column) -> Column:
    """Distinct identifiers and words of four letters or more, without case, for the stash's inverted index."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_][A-Za-z0-9_./:-]*"), 0), lambda w: F.lower(F.regexp_replace(w, r"[./:-]+$", ""))), lambda w: F.length(w) >= 4))


def hints(results: DataFrame, prompts: DataFrame, per_prompt: int = 2) -> DataFrame:
    """(session_id, result_id, score, rank): stored outputs of a session that its prompts name.

    A term weighs 3 with a digit or sign in it, 2 from eight letters on, else 1; a term's
    weight is shared by all outputs of the session that hold it. An output is a hint from
    score 3 on with a term of weight 2 or more; the best ``per_prompt`` are shown.
    """
    r = results.filter(F.col("session_id").isNotNull() & F.col("text").isNotNull()).groupBy("session_id", "result_id").agg(F.max("text").alias("text"))
    q = prompts.select("session_id", F.explode(search_terms(F.col("text"))).alias("term")).distinct()
    weight = F.when(F.col("term").rlike(r"[0-9_./:-]"), 3).when(F.length("term") >= 8, 2).otherwise(1)
    q = q.filter(~F.col("term").isin(*fixed.STOPWORDS)).withColumn("weight", weight)
    held = r.select("session_id", "result_id", F.explode(search_terms(F.col("text"))).alias("term")).join(q, ["session_id", "term"])
    df = held.groupBy("session_id", "term").agg(F.count("*").alias("df"))
    s = held.join(df, ["session_id", "term"]).groupBy("session_id", "result_id").agg(F.round(F.sum(F.col("weight") / F.col("df")), 6).alias("score"), F.max("weight").alias("top"))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("score"), "result_id"))
    return s.filter("score >= 3 and top >= 2").withColumn("rank", rank).filter(F.col("rank") <= per_prompt).select("session_id", "result_id", "score", "rank")


def handoff(s: DataFrame, messages: DataFrame, n_last: int = 3) -> DataFrame:
    """(session_id, kind, place, value): first and last prompts, newest files edited and read, last error."""
    m = messages.filter(F.col("session_id").isNotNull() & (F.lower(F.trim("role")) == "user") & (F.trim("text") != "")).groupBy("session_id", "message_index").agg(F.max("text").alias("text"))
    w = W.partitionBy("session_id")
    m = m.withColumn("up", F.row_number().over(w.orderBy("message_index"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("message_index")))).filter(f"up = 1 or down <= {n_last}")
    prompts = m.select("session_id", F.when(F.col("up") == 1, "first_prompt").otherwise("last_prompt").alias("kind"), F.col("message_index").alias("place"), F.col("text").alias("value"))
    f = s.filter("path is not null").withColumn("kind", F.when(F.col("tool").isin(*fixed.EDIT_TOOLS), "edited").when(F.col("tool") == "read", "read")).filter("kind is not null")
    f = f.groupBy("session_id", "kind", "path").agg(F.max("seq").alias("place"))
    f = f.withColumn("n", F.row_number().over(W.partitionBy("session_id", "kind").orderBy(F.desc("place"), "path"))).filter("n <= 5")
    error = s.filter("failed").groupBy("session_id").agg(F.max(F.struct("seq", "call_id")).alias("e"))
    return prompts.unionByName(f.select("session_id", "kind", "place", F.col("path").alias("value"))).unionByName(error.select("session_id", F.lit("last_error").alias("kind"), F.col("e.seq").alias("place"), F.col("e.call_id").alias("value")))


# --- accounting -----------------------------------------------------------------------------


def replay(events: DataFrame) -> DataFrame:
    """(session_id, seq, tokens, charged): how often an item is sent again.

    events: (session_id, seq, tokens, is_request, is_boundary). An item is sent with every
    later request until a boundary empties the context.
    """
    w = W.partitionBy("session_id").orderBy("seq")
    e = events.withColumn("segment", F.sum(F.col("is_boundary").cast("int")).over(w))
    after = W.partitionBy("session_id", "segment").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    e = e.withColumn("requests_after", F.coalesce(F.sum(F.col("is_request").cast("int")).over(after), F.lit(0)))
    return e.withColumn("charged", F.col("requests_after") * F.col("tokens"))


def rereads(s: DataFrame, least: int = fixed.REREAD_MIN_TOKENS) -> DataFrame:
    """(session_id, repeated_outputs, repeated_tokens): outputs of ``least`` tokens or more that the session had before."""
    w = W.partitionBy("session_id", "digest").orderBy("seq")
    r = s.filter(F.col("tokens") >= least).withColumn("nth", F.row_number().over(w)).filter("nth > 1")
    return r.groupBy("session_id").agg(F.count("*").alias("repeated_outputs"), F.sum("tokens").alias("repeated_tokens"))


def top_with_rest(df: DataFrame, label: str, value: str, n: int = 8) -> DataFrame:
    """The n greatest labels by their sums, and ``(other)`` with the rest."""
    sums = df.groupBy(F.coalesce(F.col(label), F.lit("unknown")).alias("label")).agg(F.sum(value).alias("total"))
    top = sums.orderBy(F.desc("total"), "label").limit(n)
    rest = sums.join(top, "label", "left_anti").agg(F.sum("total").alias("total")).filter("total is not null").select(F.lit("(other)").alias("label"), "total")
    return top.unionByName(rest)


def cache_states(messages: DataFrame, ttl_s: float = 300.0) -> DataFrame:
    """(state, reason, bucket, n): whether a prompt finds the session's cache warm, by idle time before it.

    A gap below 0 counts as warm (clocks that went back are no sign of a cold cache).
    """
    m = messages.filter(F.col("session_id").isNotNull()).groupBy("session_id", "message_index").agg(F.min("sent_at").alias("at"))
    w = W.partitionBy("session_id").orderBy("message_index")
    idle = F.unix_micros("at") - F.unix_micros(F.lag("at").over(w))
    m = m.withColumn("idle", idle / 1e6)
    state = F.when(F.col("idle").isNull(), "unknown:missing_timestamp").when(F.col("idle") < 0, "warm:clock_skew").when(F.col("idle") >= ttl_s, "cold:idle_past_ttl").otherwise("warm:idle_within_ttl")
    m = m.withColumn("s", state).withColumn("bucket", X.gap_bucket(F.when(F.col("idle") >= 0, F.col("idle"))))
    return m.groupBy(F.split("s", ":")[0].alias("state"), F.split("s", ":")[1].alias("reason"), "bucket").agg(F.count("*").alias("n"))


def usage_summary(reports: DataFrame) -> DataFrame:
    """(mode, provider, n, p10, p50, p90, tokens_before, gate): one GROUPING SETS pass; null is all."""
    r = reports.dropDuplicates(["report_id"]).filter("reduction_ratio is not null").withColumn("provider", F.coalesce("provider_used", F.lit("other"))).withColumn("mode", F.coalesce("mode", F.lit("other")))
    q = lambda x: F.round(F.percentile("reduction_ratio", x), 6)
    aggs = [F.count("*").alias("n"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.round(F.sum("tokens_before"), 2).alias("tokens_before"), F.count_if(F.col("reduction_ratio") < 0.25).alias("gate"), F.count_distinct("session_id").alias("n_sessions"), F.count_distinct(F.to_date("created_at")).alias("active_days")]
    return r.groupingSets([["mode", "provider"], ["mode"], []], "mode", "provider").agg(*aggs)


def token_fit(reports: DataFrame) -> DataFrame:
    """(mode, n, slope, intercept): tokens after against tokens before, least squares, from ten pairs on."""
    r = reports.dropDuplicates(["report_id"]).filter("tokens_before is not null and tokens_after is not null")
    out = r.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.regr_slope("tokens_after", "tokens_before"), 6).alias("slope"), F.round(F.regr_intercept("tokens_after", "tokens_before"), 3).alias("intercept"))
    return out.filter("n >= 10")
