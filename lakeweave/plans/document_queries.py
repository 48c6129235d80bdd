"""Document operators on the corpus, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X
from lakeweave.operators import documents as D, masking
from lakeweave.sources.tables import table

QUESTION = "Which greenhouse fan needs a new seal when the cable is wet?"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def token_estimate(spark, folder):
    return _docs(spark, folder).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def language_vote(spark, folder):
    return _docs(spark, folder).select("doc_id", X.language_vote(F.col("text")).alias("voted"))


def redaction_counts(spark, folder):
    red = D.filled(_docs(spark, folder)).select("doc_id", X.redacted(F.col("text")).alias("t"))
    return red.select("doc_id", *[X.count_matches(F.col("t"), f"<{k}>").alias(f"n_{k.lower()}") for k, _ in fixed.REDACTIONS], F.sha2("t", 256).alias("digest"))


def redacted_texts(spark, folder):
    return masking.redacted(D.filled(_docs(spark, folder)))


def secrets_masked(spark, folder):
    return D.filled(_docs(spark, folder)).select("doc_id", masking.mask_secrets("text").alias("text"))


def instruction_blocks(spark, folder):
    """Texts shaped like instructions: a standalone one is left out of what is handed on, one inside other text or quotes stays as data."""
    t = D.filled(_docs(spark, folder))
    shaped, alone, quoted = (F.col("text").rlike(p) for p in (fixed.INSTRUCTION, fixed.STANDALONE_INSTRUCTION, fixed.QUOTED_SPEECH))
    kind = F.when(shaped & alone & ~quoted, "standalone").when(shaped, "embedded")
    return t.select("doc_id", shaped.alias("instruction"), quoted.alias("quoted"), kind.alias("kind")).filter("instruction or quoted")


def content_types(spark, folder):
    t = D.filled(_docs(spark, folder)).select(X.content_type(F.col("text")).alias("content_type"))
    return t.groupBy("content_type").agg(F.count("*").alias("n"))


def dictation(spark, folder):
    t = D.filled(_docs(spark, folder)).select("doc_id", X.count_matches(F.col("text"), fixed.FILLER).alias("fillers"), F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")).alias("n_words"))
    per = F.when(F.col("n_words") > 0, F.round(F.col("fillers") * 100 / F.col("n_words"), 4)).otherwise(F.lit(0.0))
    return t.withColumn("per_hundred", per).withColumn("dictated", (F.col("fillers") >= 3) & (per >= 3))


def cut_texts(spark, folder):
    t = D.filled(_docs(spark, folder))
    return t.select("doc_id", X.cut_at_word(F.col("text"), 200).alias("head"), X.size_label(F.col("text")).alias("size"))


def term_sets(spark, folder):
    q = X.terms(F.lit(QUESTION))
    t = D.filled(_docs(spark, folder)).select("doc_id", X.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_intersect("t", q)).alias("n_both"), F.size(F.array_except(q, "t")).alias("n_missing"), F.size(F.array_union("t", q)).alias("n_any"))


def closure(spark, folder):
    docs = _docs(spark, folder)
    kept = D.select_chunks(docs, QUESTION).filter("not skipped").select("doc_id", "idx")
    return D.closure(D.relations(docs, QUESTION), kept)


def chunk_table(spark, folder):
    return D.chunks(_docs(spark, folder)).drop("text")


def _on(f, *args):
    return lambda spark, folder: f(_docs(spark, folder), *args)


QUERIES = {
    "optimize_savings": _on(D.savings),
    "token_estimate": token_estimate,
    "stage_contributions": _on(D.stage_contributions),
    "cleaning_recommendation": _on(D.recommendation),
    "boilerplate_counts": _on(D.boilerplate_counts),
    "structure_metrics": _on(D.structure),
    "line_table": _on(D.line_table),
    "chunk_inventory": chunk_table,
    "doc_exact_duplicates": _on(D.exact_duplicates),
    "term_document_frequency": _on(D.document_frequency),
    "mechanical_score": _on(D.mechanical_score, QUESTION),
    "bm25_goal": _on(D.bm25, QUESTION),
    "lexical_selection": _on(D.select_chunks, QUESTION),
    "relation_edges": _on(D.relations, QUESTION),
    "relation_closure": closure,
    "language_vote": language_vote, "redacted_texts": redacted_texts, "secrets_masked": secrets_masked,
    "redaction_counts": redaction_counts,
    "instruction_blocks": instruction_blocks,
    "content_types": content_types,
    "dictation_signals": dictation,
    "cut_texts": cut_texts,
    "term_sets": term_sets,
}

# --- SQL twins ------------------------------------------------------------------------------

_Q = "['" + "','".join(["greenhouse", "fan", "needs", "new", "seal", "cable", "wet"]) + "']"
_STOP = "(" + ",".join(f"'{w}'" for w in fixed.STOPWORDS) + ")"
_T = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = r"[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _est(t: str) -> str:
    u = f"regexp_replace(coalesce({t},''), '\\A{_WS}|{_WS}\\z', '', 'g')"
    return f"CASE WHEN {u} = '' THEN 0 ELSE greatest(1, CAST(round_even((len({t}) / 4.0 + len(string_split_regex({u}, '{_WS}')) / 0.75) / 2, 0) AS BIGINT)) END"


def _words(t: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda w: len(w) >= {least} AND w NOT IN {_STOP})"


def _normalized(t: str) -> str:
    t = f"replace(replace(regexp_replace({t}, '^﻿', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace({t}, '[ \\t\\f\\v]+(\\n|\\z)', '\\1', 'g')"
    t = f"regexp_replace({t}, '(\\S)[ \\t]{{2,}}(\\S)', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '(\\S)[ \\t]{{2,}}(\\S)', '\\1 \\2', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A\\n+|\\n+\\z', '', 'g')"


def _kind(line: str) -> str:
    t = f"regexp_replace({line}, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {_s(p)}) THEN '{k}'" for k, p in fixed.BOILERPLATE) + " END"


def _paras(t: str) -> str:
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"list_filter(list_transform(string_split_regex({t}, '\\n[ \\t]*\\n'), lambda p: regexp_replace(p, '\\A[ \\t\\r\\n]+|[ \\t\\r\\n]+\\z', '', 'g')), lambda p: p <> '')"


_CLEAN = f"""
a AS (SELECT doc_id, text, {_normalized("text")} AS normalized FROM {_T}),
b AS (SELECT *, array_to_string(list_filter(string_split(normalized, chr(10)), lambda x: {_kind("x")} IS NULL), chr(10)) AS plain FROM a),
c AS (SELECT *, {_paras("plain")} AS ps FROM b),
d AS (SELECT *, list_transform(ps, lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS ks FROM c),
e AS (SELECT *, list_filter(range(1, len(ps) + 1), lambda i: list_position(ks, ks[i]) = i) AS firsts FROM d),
clean AS (SELECT *, coalesce(array_to_string(list_transform(firsts, lambda i: ps[i]), chr(10) || chr(10)), '') AS uniq FROM e)"""
_SAVINGS = f"""{_CLEAN},
s0 AS (SELECT doc_id, {_est("text")} AS tokens_before, {_est("uniq")} AS tokens_after, len(ps) AS n_paragraphs, len(ps) - len(firsts) AS n_removed, sha256(uniq) AS digest FROM clean),
sav AS (SELECT *, tokens_before - tokens_after AS saved, CASE WHEN tokens_before > 0 THEN round((tokens_before - tokens_after) * 100 / tokens_before, 2) ELSE 0.0 END AS saved_percent FROM s0)"""
_LINES = f"lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {_T})))"
_CHUNKS = f"""{_LINES},
lt AS (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM lines),
isl AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lt WHERE NOT regexp_full_match(line, '\\s*')),
ch0 AS (SELECT doc_id, min(line_no) AS l0, max(line_no) AS l1, min(char_start) AS char_start, string_agg(line, chr(10) ORDER BY line_no) AS text FROM isl GROUP BY doc_id, island),
ch1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l0) - 1 AS idx, char_start + len(text) AS char_end FROM ch0),
ch2 AS (SELECT *, 'chunk_' || lpad(CAST(idx + 1 AS VARCHAR), CAST(greatest(4, len(CAST(idx + 1 AS VARCHAR))) AS INTEGER), '0') || '_' || sha256(idx || chr(0) || CAST(char_start AS BIGINT) || chr(0) || CAST(char_end AS BIGINT) || chr(0) || text)[:12] AS chunk_id, regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS key FROM ch1),
ch3 AS (SELECT *, first_value(chunk_id) OVER (PARTITION BY doc_id, key ORDER BY idx) AS fst FROM ch2),
chunks AS (SELECT doc_id, idx, chunk_id, CASE WHEN l0 = l1 AND regexp_matches(key, '^#{{1,6}}[ \\t]+\\S') THEN 'heading' ELSE 'paragraph_block' END AS label, char_start, char_end, l0 + 1 AS line_start, l1 + 1 AS line_end, CASE WHEN fst <> chunk_id THEN fst END AS duplicate_of, {_est("text")} AS tokens, text FROM ch3)"""
_SELECTED = f"""{_CHUNKS},
hc AS (SELECT doc_id, idx, label, duplicate_of IS NOT NULL AS repeated, list_intersect(list_distinct({_words("text")}), {_Q}) AS hits FROM chunks),
rare AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(hits) AS term FROM hc WHERE NOT repeated) GROUP BY doc_id, term HAVING count(*) <= 2),
hr AS (SELECT hc.*, EXISTS (SELECT 1 FROM rare r WHERE r.doc_id = hc.doc_id AND list_contains(hits, r.term)) AS is_rare,
  last_value(CASE WHEN label = 'heading' THEN idx END IGNORE NULLS) OVER w AS head_idx, last_value(CASE WHEN label = 'heading' THEN len(hits) > 0 END IGNORE NULLS) OVER w AS head_hit FROM hc WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sel0 AS (SELECT doc_id, idx, repeated AS skipped, concat_ws(',', CASE WHEN label = 'heading' AND len(hits) > 0 THEN 'heading_match' END, CASE WHEN label <> 'heading' AND len(hits) > 0 THEN 'keyword_overlap' END,
  CASE WHEN label <> 'heading' AND is_rare THEN 'rare_term_match' END, CASE WHEN label <> 'heading' AND head_hit AND idx - head_idx <= 3 THEN 'matched_heading_proximity' END) AS reasons FROM hr),
sel AS (SELECT * FROM sel0 WHERE reasons <> '')"""
_EDGES = f"""cn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) WHERE n > 1),
dup AS (SELECT a.doc_id, a.idx AS src, b.idx AS dst, 'DUPLICATES' AS type, 1.0::DOUBLE AS confidence FROM cn a JOIN cn b ON a.doc_id = b.doc_id AND a.duplicate_of = b.chunk_id),
p0 AS (SELECT doc_id, idx, n, unnest(list_filter(list_distinct({_words("text", 4)}), lambda w: NOT list_contains({_Q}, w))) AS term FROM cn),
p1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM p0) WHERE df > 1 AND df <= least(64, greatest(2, n // 2))),
sh AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, count(*) AS shared FROM p1 a JOIN p1 b ON a.doc_id = b.doc_id AND a.term = b.term AND a.idx < b.idx GROUP BY ALL),
both_ways AS (SELECT doc_id, i AS idx, j AS other, shared FROM sh UNION ALL SELECT doc_id, j, i, shared FROM sh),
cue AS (SELECT doc_id, idx, CASE WHEN regexp_matches(text, {_s(fixed.SUPERSESSION)}) THEN {{'type': 'SUPERSEDES', 'least': 1, 'confidence': 0.75::DOUBLE}}
  WHEN regexp_matches(text, {_s(fixed.QUALIFIER)}) THEN {{'type': 'QUALIFIES', 'least': CASE WHEN len(text) >= 80 THEN 2 ELSE 1048576 END, 'confidence': 0.7::DOUBLE}}
  WHEN regexp_matches(text, {_s(fixed.NEGATION)}) THEN {{'type': 'CONTRADICTS', 'least': 2, 'confidence': 0.6::DOUBLE}} END AS cue FROM cn),
edges AS (SELECT * FROM dup UNION ALL SELECT doc_id, j, i, 'SUPPORTS', 0.6::DOUBLE FROM sh WHERE shared >= 2
  UNION ALL SELECT doc_id, idx, min(other), cue.type, cue.confidence FROM cue JOIN both_ways USING (doc_id, idx) WHERE cue IS NOT NULL AND shared >= cue.least GROUP BY doc_id, idx, cue.type, cue.confidence)"""


def _redacted(t: str) -> str:
    for k, p in fixed.REDACTIONS:
        t = f"regexp_replace({t}, {_s(p)}, '<{k}>', 'g')"
    return t


_LANG_HITS = ", ".join(f"len(list_filter(ws, lambda w: w IN ({','.join(_s(x) for x in m)}))) AS {k}" for k, m in fixed.LANGUAGE_MARKERS.items())

SQL = {
    "optimize_savings": f"WITH {_SAVINGS} SELECT * FROM sav",
    "token_estimate": f"SELECT doc_id, {_est('text')} AS tokens FROM documents",
    "stage_contributions": f"""WITH {_CLEAN}, t AS (SELECT {_est("text")} AS t0, {_est("normalized")} AS t1, {_est("plain")} AS t2, {_est("uniq")} AS t3 FROM clean),
        r AS (SELECT 'normalize' AS stage, t0 AS i, t1 AS o FROM t UNION ALL SELECT 'boilerplate', t1, t2 FROM t UNION ALL SELECT 'deduplicate', t2, t3 FROM t)
        SELECT stage, count(*) AS n_docs, sum(i) AS tokens_in, sum(o) AS tokens_out, sum(i - o) AS tokens_saved FROM r GROUP BY stage""",
    "cleaning_recommendation": f"""WITH {_SAVINGS}, r AS (SELECT *, CASE WHEN n_paragraphs > 0 THEN round(n_removed / n_paragraphs, 4) ELSE 0.0 END AS duplicate_ratio FROM sav),
        w AS (SELECT *, CASE WHEN tokens_after >= 100000 THEN 'manual_review:large_after_cleaning' WHEN tokens_before < 80 THEN 'skip:small_input' WHEN saved_percent < 5 OR saved < 20 THEN 'skip:low_projected_savings'
          WHEN duplicate_ratio >= 0.2 AND n_removed >= 1 THEN 'optimize_safe:high_duplication' WHEN saved_percent >= 15 OR saved >= 50 THEN 'optimize_safe:high_projected_savings' ELSE 'skip:low_projected_savings' END AS x FROM r)
        SELECT doc_id, split_part(x, ':', 1) AS action, split_part(x, ':', 2) AS reason, duplicate_ratio, saved, saved_percent FROM w""",
    "boilerplate_counts": f"WITH {_LINES}, k AS (SELECT doc_id, {_kind('line')} AS kind FROM lines) SELECT kind, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM k WHERE kind IS NOT NULL GROUP BY kind",
    "structure_metrics": f"""SELECT doc_id, len(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[ \\t\\r]*'))) AS n_filled_lines,
        coalesce(list_max(list_transform(string_split(text, chr(10)), lambda x: len(x))), 0) AS longest_line, len(ps) AS n_paragraphs, coalesce(list_max(list_transform(ps, lambda x: len(x))), 0) AS longest_paragraph,
        len(regexp_extract_all(text, '\\n(?:[ \\t]*\\n)+')) AS blank_runs FROM (SELECT *, {_paras("text")} AS ps FROM {_T})""",
    "line_table": f"WITH {_LINES} SELECT *, CAST(coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM lines",
    "chunk_inventory": f"WITH {_CHUNKS} SELECT doc_id, idx, chunk_id, label, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, line_start, line_end, duplicate_of, tokens FROM chunks",
    "doc_exact_duplicates": "SELECT * FROM (SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY text) AS first_doc_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text <> '') WHERE n_copies > 1",
    "term_document_frequency": f"SELECT term, count(*) AS n_docs FROM (SELECT unnest(list_distinct({_words('text')})) AS term FROM {_T}) GROUP BY term",
    "mechanical_score": f"""WITH t AS (SELECT doc_id, len(text) AS n, len(list_intersect(list_distinct({_words("text")}), {_Q})) AS overlap FROM {_T}), s AS (SELECT *, round_even(least(1.0, overlap / 6.0), 2) AS score FROM t)
        SELECT doc_id, overlap, score, CASE WHEN n < 80 THEN 'short_block' WHEN score > 0 THEN 'lexical_overlap' ELSE 'no_lexical_overlap' END AS decision FROM s""",
    "bm25_goal": f"""WITH t AS (SELECT doc_id, {_words("text")} AS ws FROM {_T}), tot AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM t),
        tf AS (SELECT doc_id, l, term, count(*) AS f FROM (SELECT doc_id, len(ws) AS l, unnest(list_filter(ws, lambda w: list_contains({_Q}, w))) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
        SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / avg_len))), 6) AS score FROM tf JOIN df USING (term), tot GROUP BY doc_id""",
    "lexical_selection": f"WITH {_SELECTED} SELECT doc_id, idx, reasons, skipped FROM sel",
    "relation_edges": f"WITH {_CHUNKS}, {_EDGES} SELECT * FROM edges",
    "relation_closure": f"""WITH {_SELECTED}, {_EDGES}, kept AS (SELECT doc_id, idx FROM sel WHERE NOT skipped),
        bw AS (SELECT doc_id, src AS idx, dst AS other, type, confidence FROM edges UNION ALL SELECT doc_id, dst, src, type, confidence FROM edges),
        near AS (SELECT * FROM bw SEMI JOIN kept ON bw.doc_id = kept.doc_id AND bw.other = kept.idx ANTI JOIN kept k2 ON bw.doc_id = k2.doc_id AND bw.idx = k2.idx)
        SELECT doc_id, idx, type, confidence FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY confidence DESC, type, other) = 1""",
    "language_vote": f"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+|[0-9]+'), lambda w: lower(w)) AS ws FROM documents), h AS (SELECT doc_id, len(ws) AS n, {_LANG_HITS} FROM t),
        v AS (SELECT doc_id, n, list_sort([{{'n': pt, 'o': 0, 't': 'pt'}}, {{'n': es, 'o': -1, 't': 'es'}}, {{'n': fr, 'o': -2, 't': 'fr'}}, {{'n': de, 'o': -3, 't': 'de'}}], 'DESC') AS r FROM h)
        SELECT doc_id, CASE WHEN n >= 12 AND r[1].n >= 3 AND r[1].n > r[2].n * 1.5 THEN r[1].t END AS voted FROM v""",
    "redaction_counts": f"WITH r AS (SELECT doc_id, {_redacted('text')} AS t FROM {_T}) SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(t, '<{k}>')) AS n_{k.lower()}" for k, _ in fixed.REDACTIONS) + ", sha256(t) AS digest FROM r",
    "instruction_blocks": f"SELECT doc_id, instruction, quoted, CASE WHEN instruction AND alone AND NOT quoted THEN 'standalone' WHEN instruction THEN 'embedded' END AS kind FROM (SELECT doc_id, regexp_matches(text, {_s(fixed.INSTRUCTION)}) AS instruction, regexp_matches(text, {_s(fixed.QUOTED_SPEECH)}) AS quoted, regexp_matches(text, {_s(fixed.STANDALONE_INSTRUCTION)}) AS alone FROM {_T}) WHERE instruction OR quoted",
    "content_types": f"""WITH t AS (SELECT text, regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS t FROM {_T}), l AS (SELECT text, t, string_split(t, chr(10)) AS ls FROM t),
        h AS (SELECT text, t, len(ls) AS n, {", ".join(f"len(list_filter(ls, lambda x: regexp_matches(x, {_s(p)}))) AS {k}" for k, p in fixed.LINE_LOOKS.items())} FROM l)
        SELECT CASE WHEN t = '' THEN 'prose' WHEN regexp_matches(text, {_s(fixed.HIGH_RISK)}) AND len(text) > 200 THEN 'high_risk' WHEN regexp_matches(t, '(?m)^\\s*(`{{3,}}|~{{3,}})') THEN 'code' WHEN regexp_matches(t, '^[\\[{{]') THEN 'json' WHEN regexp_matches(t, '^<') AND regexp_matches(t, '<[a-zA-Z][^>]*>') THEN 'xml'
          WHEN n >= 3 AND markdown_table > 0 THEN 'markdown_table' WHEN n >= 2 AND yaml >= greatest(2, n // 2) THEN 'yaml' WHEN n >= 3 AND logs >= 2 THEN 'logs' WHEN n >= 2 AND code > 0 THEN 'code' WHEN config >= 2 THEN 'config' WHEN regexp_matches(t, '^#') THEN 'markdown' ELSE 'prose' END AS content_type, count(*) AS n FROM h GROUP BY 1""",
    "dictation_signals": f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, {_s("(" + fixed.FILLER + ")")})) AS fillers, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS n_words FROM {_T}),
        p AS (SELECT *, CASE WHEN n_words > 0 THEN round(fillers * 100 / n_words, 4) ELSE 0.0 END AS per_hundred FROM t) SELECT *, fillers >= 3 AND per_hundred >= 3 AS dictated FROM p""",
    "term_sets": f"""WITH t AS (SELECT doc_id, list_distinct({_words("text")}) AS t FROM {_T}), u AS (SELECT doc_id, len(t) AS n_terms, len(list_intersect(t, {_Q})) AS n_both FROM t)
        SELECT doc_id, n_terms, n_both, 7 - n_both AS n_missing, n_terms + 7 - n_both AS n_any FROM u""",
    "cut_texts": f"""SELECT doc_id, CASE WHEN len(text) <= 200 OR regexp_full_match(text[201:201], '\\s') THEN text[:200] ELSE coalesce(nullif(regexp_extract(text[:200], '(?s)^(.*\\S)\\s+\\S*$', 1), ''), text[:200]) END AS head,
        CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE printf('%.1f KB', round_even(strlen(text) / 1024, 1)) END AS size FROM {_T}""",
}
