"""Blocks, sentences, spans, vectors, log readers and streams, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import text as X
from lakeweave.operators import documents as D
from lakeweave.operators import segments as G
from lakeweave.operators import spans as S
from lakeweave.operators import vectors as V
from lakeweave.plans.document_queries import _CHUNKS, _T
from lakeweave.sources import sessions as L
from lakeweave.sources.tables import table
from lakeweave.streaming import live


def _docs(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return G.blocks(_docs(spark, folder)).select("doc_id", "idx", "block_id", "char_start", "char_end", "is_protected", "reason")


def block_rebuild(spark, folder):
    """Blocks and gaps are the text: one row per document that has any."""
    return G.rebuilt(G.blocks(_docs(spark, folder))).select("doc_id", F.sha2("text", 256).alias("digest"))


def cleaned(spark, folder):
    return G.cleaned(_docs(spark, folder)).select("doc_id", F.length("text").alias("n_chars"), "n_trailing", "n_inner", "n_exact", "n_near")


def sentences(spark, folder):
    return G.sentences(_docs(spark, folder)).select("doc_id", "idx", "sentence", "role", "topic")


def _chunk_spans(spark, folder):
    return D.chunks(table(spark, folder, "documents")).select("doc_id", F.col("char_start").alias("span_start"), F.col("char_end").alias("span_end"))


def _line_spans(spark, folder):
    lines = D.line_table(table(spark, folder, "documents"))
    return lines.select("doc_id", F.col("char_start").alias("span_start"), (F.col("char_start") + F.length("line")).alias("span_end"))


def merged(spark, folder):
    """Lines with a capital first letter, and the runs they make with the line before or after."""
    lines = D.line_table(table(spark, folder, "documents")).filter(F.col("line").rlike("^[A-Z]"))
    return S.merge_spans(lines.select("doc_id", F.col("char_start").alias("span_start"), (F.col("char_start") + F.length("line") + 1).alias("span_end")), "doc_id")


def overlap(spark, folder):
    return S.overlaps(_chunk_spans(spark, folder), _line_spans(spark, folder), "doc_id").groupBy("doc_id", "ls").agg(F.count("*").alias("n_lines"), F.max("re").alias("last_end"))


def quotes_removed(spark, folder):
    """Texts without quoted lines."""
    docs = D.filled(table(spark, folder, "documents"))
    lines = D.line_table(docs).filter(F.col("line").startswith(">"))
    cut = lines.select("doc_id", F.col("char_start").alias("span_start"), (F.col("char_start") + F.length("line") + 1).alias("span_end"))
    return S.removed(docs, cut, "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


def events_as_of(spark, folder):
    """Every purchase with the value of the user's last view before it."""
    e = table(spark, folder, "events")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", "ts", "value")
    return S.as_of(buys, views, "user_id", "ts", "value")


def event_gaps(spark, folder):
    from pyspark.sql import Window as W

    e = table(spark, folder, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 1e6
    return e.select(gap.alias("gap")).groupBy(X.gap_bucket(F.col("gap")).alias("bucket")).agg(F.count("*").alias("n"))


def chunk_features(spark, folder):
    """Position and repetition features of a document's chunks."""
    from pyspark.sql import Window as W

    c = D.chunks(table(spark, folder, "documents")).withColumn("n", F.length("text"))
    doc = W.partitionBy("doc_id")
    by = doc.orderBy("idx")
    same = W.partitionBy("doc_id", "text")
    return c.select(
        "doc_id", "idx", F.round(F.percent_rank().over(by), 6).alias("pos01"), F.round(F.percent_rank().over(doc.orderBy("n")), 6).alias("length01"),
        F.round(F.coalesce(F.sum("n").over(by.rowsBetween(1, W.unboundedFollowing)), F.lit(0)) / F.sum("n").over(doc), 6).alias("after_share"),
        ((F.col("n") >= 40) & (F.max("idx").over(same) > F.col("idx"))).alias("dup_later"), ((F.col("n") >= 40) & (F.min("idx").over(same) < F.col("idx"))).alias("dup_earlier"),
        (F.max("idx").over(doc) - F.col("idx")).alias("from_end"),
    )


def vector_check(spark, folder):
    return V.check(table(spark, folder, "embeddings"), 64)


def vector_nearest(spark, folder):
    e = table(spark, folder, "embeddings")
    return V.nearest(e, e.filter("vec_id % 100 = 0"))


def log_events(spark, folder):
    """What calls were given is told by its length alone: objects have no order of members to compare."""
    e = L.log_events(table(spark, folder, "raw_log"))
    return e.withColumn("text", F.when(F.col("kind") != "call", F.col("text")))


def log_usage(spark, folder):
    """Billed input and output tokens per file, with the number of context boundaries."""
    e = L.log_events(table(spark, folder, "raw_log"))
    return e.groupBy("file_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("kind") == "boundary").alias("boundaries"), F.count_if(F.col("kind") == "call").alias("calls"))


def payload_json(spark, folder):
    return L.payload_rows(table(spark, folder, "transcripts"))


def payload_round_trip(spark, folder):
    t = table(spark, folder, "transcripts")
    back = L.parse_payload(L.payload_rows(t))
    return back.select("transcript_id", "message_index", "role", "text", F.coalesce(F.size("toolUses"), F.lit(-1)).alias("n_uses"), F.coalesce(F.size("toolResults"), F.lit(-1)).alias("n_results"))


def toon_capacities(spark, folder):
    t = table(spark, folder, "mix_targets").withColumn("kind", F.lit("mix"))
    return L.toon(t.select("kind", "source", "max_repeats"), "targets", "kind")


def _batch(spark, folder, mode, f):
    return live.run(f(live.read(spark, folder, "events")), mode)


QUERIES = {
    "block_split": blocks, "block_rebuild": block_rebuild, "near_paragraph_dedup": cleaned, "sentence_roles": sentences, "merge_spans": merged, "interval_overlap_join": overlap, "quoted_lines_removed": quotes_removed,
    "as_of_join": events_as_of, "idle_gap_buckets": event_gaps, "chunk_features": chunk_features, "vector_check": vector_check, "vector_nearest": vector_nearest, "log_events": log_events, "log_usage": log_usage,
    "payload_json": payload_json, "payload_round_trip": payload_round_trip, "toon_table": toon_capacities,
    "stream_dedup": lambda s, f: _batch(s, f, "append", lambda e: live.once(e, "event_id")).groupBy("event_type").agg(F.count("*").alias("n")),
    "stream_idle_sessions": lambda s, f: _batch(s, f, "complete", lambda e: live.idle_sessions(e, "user_id", "2 hours")),
    "stream_windows": lambda s, f: _batch(s, f, "complete", lambda e: live.windows(e, "event_type", "1 hour")),
    "stream_sticky": lambda s, f: _batch(s, f, "append", lambda e: live.sticky(e, "user_id", "event_type")),
}

# --- SQL twins ------------------------------------------------------------------------------

_LT = f"lt0 AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {_T}))), lt1 AS (SELECT *, CAST(coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM lt0)"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_V = "CASE WHEN json_valid(line) THEN line::JSON END"


def _j(path: str) -> str:
    return f"json_extract_string(v, '{path}')"


_LOG = f"""raw AS (SELECT DISTINCT file_id, record_index, line FROM raw_log), pv AS (SELECT file_id, record_index, {_V} AS v FROM raw), po AS (SELECT *, {_j("$.type")} AS type FROM pv WHERE json_type(v) = 'OBJECT'),
d1 AS (SELECT file_id, record_index, v, unnest(CASE WHEN json_type(v, '$.message.content') = 'ARRAY' THEN json_extract(v, '$.message.content[*]') ELSE [NULL] END) AS p, unnest(CASE WHEN json_type(v, '$.message.content') = 'ARRAY' THEN range(len(json_extract(v, '$.message.content[*]'))) ELSE [-1] END) AS i FROM po WHERE type IN ('user', 'assistant')),
e1 AS (SELECT file_id, record_index, greatest(i, 0)::INTEGER AS part, CASE WHEN i < 0 THEN 'message' ELSE CASE json_extract_string(p, '$.type') WHEN 'tool_use' THEN 'call' WHEN 'tool_result' THEN 'result' WHEN 'text' THEN 'message' END END AS kind, {_j("$.message.role")} AS role,
  coalesce(json_extract_string(p, '$.id'), json_extract_string(p, '$.tool_use_id')) AS call_id, json_extract_string(p, '$.name') AS tool, CASE WHEN i < 0 THEN {_j("$.message.content")} ELSE coalesce(json_extract_string(p, '$.text'), json_extract_string(p, '$.content')) END AS text, NULL::BIGINT AS input_tokens, NULL::BIGINT AS output_tokens FROM d1
  UNION ALL SELECT file_id, record_index, 1000, 'usage', NULL, NULL, NULL, NULL, TRY_CAST({_j("$.message.usage.input_tokens")} AS BIGINT), TRY_CAST({_j("$.message.usage.output_tokens")} AS BIGINT) FROM po WHERE type IN ('user', 'assistant') AND json_extract(v, '$.message.usage') IS NOT NULL),
t2 AS (SELECT *, {_j("$.payload.type")} AS t FROM po WHERE type = 'response_item'),
e2 AS (SELECT file_id, record_index, 0 AS part, CASE WHEN t = 'message' THEN 'message' WHEN t IN ('function_call', 'custom_tool_call', 'local_shell_call', 'web_search_call') THEN 'call' WHEN t IN ('function_call_output', 'custom_tool_call_output') THEN 'result' END AS kind,
  CASE WHEN t = 'message' THEN {_j("$.payload.role")} WHEN t LIKE '%_output' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN t <> 'message' THEN coalesce({_j("$.payload.call_id")}, {_j("$.payload.id")}) END AS call_id, CASE WHEN t LIKE '%_call' THEN {_j("$.payload.name")} END AS tool,
  CASE WHEN t = 'message' THEN CASE WHEN json_type(v, '$.payload.content') = 'ARRAY' THEN array_to_string(list_transform(json_extract(v, '$.payload.content[*]'), lambda x: json_extract_string(x, '$.text')), chr(10)) ELSE {_j("$.payload.content")} END WHEN t LIKE '%_output' THEN CASE WHEN json_type(v, '$.payload.output') = 'OBJECT' THEN {_j("$.payload.output.content")} ELSE {_j("$.payload.output")} END ELSE coalesce({_j("$.payload.arguments")}, {_j("$.payload.input")}) END AS text, NULL::BIGINT, NULL::BIGINT FROM t2),
e3 AS (SELECT file_id, record_index, 0, 'usage', NULL, NULL, NULL, NULL, TRY_CAST({_j("$.payload.info.last_token_usage.input_tokens")} AS BIGINT), TRY_CAST({_j("$.payload.info.last_token_usage.output_tokens")} AS BIGINT) FROM po WHERE type = 'event_msg' AND {_j("$.payload.type")} = 'token_count'
  UNION ALL SELECT file_id, record_index, 0, 'boundary', NULL, NULL, NULL, NULL, NULL, NULL FROM po WHERE type NOT IN ('user', 'assistant', 'response_item') AND (type = 'compacted' OR {_j("$.subtype")} = 'compact_boundary')),
log AS (SELECT * FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) WHERE kind IS NOT NULL)"""
_ONE = "SELECT DISTINCT ON (transcript_id) transcript_id, payload FROM transcripts ORDER BY transcript_id"

SQL = {
    "block_rebuild": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text <> ''",
    "sentence_roles": f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: regexp_matches(s, '\\w')) AS ss FROM documents WHERE text IS NOT NULL),
        r AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM t)),
        x AS (SELECT *, CASE WHEN sentence LIKE '%?' THEN 'ask' WHEN regexp_matches(sentence, '{G.RULE.replace("'", "''")}') THEN 'constraint' WHEN regexp_matches(sentence, '{G.ASK.replace("'", "''")}') THEN 'ask' ELSE 'context' END AS role,
          list_distinct(list_transform(regexp_extract_all(lower(sentence), '\\p{{L}}{{4,}}'), lambda w: w[:5])) AS stems FROM r),
        y AS (SELECT *, lag(stems) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM x)
        SELECT doc_id, idx, sentence, role, sum(CASE WHEN before IS NULL OR regexp_matches(sentence, '{G.SHIFT.replace("'", "''")}') OR NOT list_has_any(stems, before) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS topic FROM y""",
    "merge_spans": f"""WITH {_LT}, s AS (SELECT doc_id, char_start AS a, char_start + len(line) + 1 AS b FROM lt1 WHERE regexp_matches(line, '^[A-Z]')),
        n AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s), i AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS g FROM n)
        SELECT doc_id, min(a) AS span_start, max(b) AS span_end, count(*) AS n FROM i GROUP BY doc_id, g""",
    "interval_overlap_join": f"WITH {_CHUNKS}, l AS (SELECT doc_id, char_start AS rs, char_start + len(line) AS re FROM lt) SELECT c.doc_id, CAST(c.char_start AS BIGINT) AS ls, count(*) AS n_lines, CAST(max(re) AS BIGINT) AS last_end FROM chunks c JOIN l ON c.doc_id = l.doc_id AND c.char_start < l.re AND l.rs < c.char_end AND l.re > l.rs GROUP BY ALL",
    "quoted_lines_removed": f"WITH {_LT}, k AS (SELECT doc_id, max(line_no) AS m, coalesce(string_agg(line || chr(10), '' ORDER BY line_no) FILTER (NOT starts_with(line, '>')), '') AS t, max(CASE WHEN starts_with(line, '>') THEN line_no ELSE -1 END) AS q FROM lt0 GROUP BY doc_id), f AS (SELECT doc_id, CASE WHEN q = m OR t = '' THEN t ELSE t[:-2] END AS t FROM k) SELECT doc_id, sha256(t) AS digest, len(t) AS n_chars FROM f",
    "as_of_join": "SELECT event_id, user_id, ts, (SELECT v.value FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts ORDER BY v.ts DESC LIMIT 1) AS value FROM events e WHERE event_type = 'purchase'",
    "idle_gap_buckets": "WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < 300 THEN '<5m' WHEN gap < 3600 THEN '5m-1h' WHEN gap < 7200 THEN '1h-2h' WHEN gap < 28800 THEN '2h-8h' ELSE '>8h' END AS bucket, count(*) AS n FROM g GROUP BY 1",
    "chunk_features": f"""WITH {_CHUNKS}, c AS (SELECT doc_id, idx, text, len(text) AS n FROM chunks)
        SELECT doc_id, idx, round(percent_rank() OVER (PARTITION BY doc_id ORDER BY idx), 6) AS pos01, round(percent_rank() OVER (PARTITION BY doc_id ORDER BY n), 6) AS length01,
        round(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) / sum(n) OVER (PARTITION BY doc_id), 6) AS after_share,
        n >= 40 AND max(idx) OVER (PARTITION BY doc_id, text) > idx AS dup_later, n >= 40 AND min(idx) OVER (PARTITION BY doc_id, text) < idx AS dup_earlier, max(idx) OVER (PARTITION BY doc_id) - idx AS from_end FROM c""",
    "vector_check": "SELECT CASE WHEN vec_id IS NULL THEN 'null_id' WHEN n > 1 THEN 'duplicate_id' WHEN embedding IS NULL THEN 'null_vector' WHEN len(embedding) <> 64 THEN 'wrong_dims' ELSE 'ok' END AS reason, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM embeddings) GROUP BY 1",
    "vector_nearest": f"""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / {_NORM}) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_inner_product(q.v, r.v), 6) AS score FROM u q JOIN u r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""",
    "log_events": f"WITH {_LOG} SELECT * REPLACE (CASE WHEN kind <> 'call' THEN text END AS text) FROM log",
    "log_usage": f"WITH {_LOG} SELECT file_id, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, count(*) FILTER (kind = 'boundary') AS boundaries, count(*) FILTER (kind = 'call') AS calls FROM log GROUP BY file_id",
    "payload_round_trip": f"""SELECT transcript_id, CAST(i - 1 AS INTEGER) AS message_index, payload[i].role AS role, payload[i].text AS text, coalesce(len(payload[i].toolUses), -1) AS n_uses, coalesce(len(payload[i].toolResults), -1) AS n_results
        FROM (SELECT transcript_id, payload, unnest(range(1, len(payload) + 1)) AS i FROM ({_ONE}))""",
    "toon_table": "SELECT 'mix' AS kind, 'targets[' || count(*) || ']{source,max_repeats}:' || chr(10) || string_agg(source || ',' || max_repeats, chr(10) ORDER BY source) AS toon FROM mix_targets",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stream_idle_sessions": """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
        SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS ended, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, s""",
    "stream_windows": "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_sticky": "SELECT user_id, event_type, unnest(range(1, least(2, count(*)) + 1))::INTEGER AS nth FROM events GROUP BY user_id, event_type",
}
