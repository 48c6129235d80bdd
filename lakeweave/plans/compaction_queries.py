"""Compaction, speech and pointer operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import fixed, udtf
from lakeweave.operators import compaction as P
from lakeweave.operators import documents as D
from lakeweave.operators import speech, spans
from lakeweave.plans.document_queries import _CHUNKS, _EDGES, _Q, _T, QUESTION, _normalized, _s, _words
from lakeweave.sources.tables import table

MARKERS = ["greenhouse", "Sunday", "no such marker"]


def _docs(spark, folder):
    return table(spark, folder, "documents")


def _scored(spark, folder):
    return P.scored(_docs(spark, folder), QUESTION)


def budget_drop(spark, folder):
    return P.budget_drop(_scored(spark, folder))


def restore(spark, folder):
    return P.restore(D.relations(_docs(spark, folder), QUESTION), budget_drop(spark, folder))


def assembled(spark, folder):
    out = P.assembled(_scored(spark, folder), budget_drop(spark, folder))
    return out.select("doc_id", F.sha2("text", 256).alias("digest"), "n_markers")


def coverage(spark, folder):
    return P.coverage(D.filled(_docs(spark, folder)), MARKERS)


def differences(spark, folder):
    """Texts against their normalized ones."""
    c = D.clean(_docs(spark, folder))
    return P.differences(c.select("doc_id", "text"), c.select("doc_id", F.col("normalized").alias("text")).filter("text <> ''"))


def line_pointers(spark, folder):
    return P.line_range_pointers(table(spark, folder, "results"))


def key_features(spark, folder):
    return P.key_features(table(spark, folder, "results"))


def speech_signals(spark, folder):
    t = D.filled(_docs(spark, folder))
    return t.select("doc_id", speech.is_speech(F.col("text")).alias("speech"), speech.dictation(F.col("text")).alias("dictated"))


def speech_removals(spark, folder):
    """Characters that speech cleaning takes from each text, by kind."""
    r = speech.removals(_docs(spark, folder))
    return r.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("span_end") - F.col("span_start")).alias("n_chars"))


def speech_cleaned(spark, folder):
    docs = D.filled(_docs(spark, folder))
    return spans.removed(docs, speech.removals(docs), "doc_id").select("doc_id", F.length("text").alias("n_chars"))


def sql_blocks(spark, folder):
    """Blocks by the table function, in SQL."""
    udtf.register(spark)
    return spark.sql("SELECT doc_id, b.idx, b.block_id FROM {docs}, LATERAL split_blocks(text) b", docs=_docs(spark, folder))


QUERIES = {
    "budget_drop": budget_drop, "restoration_rank": restore, "assembled_texts": assembled, "marker_coverage": coverage, "text_differences": differences, "line_range_pointers": line_pointers,
    "identifier_features": key_features, "speech_signals": speech_signals, "speech_removals": speech_removals, "speech_cleaned": speech_cleaned, "sql_blocks": sql_blocks,
}

_SCORED = f"""{_CHUNKS},
sc AS (SELECT doc_id, idx, text, len(text) AS n_chars, round_even(least(1.0, len(list_intersect(list_distinct({_words("text")}), {_Q})) / 6.0), 2) AS score, len(text) < 80 OR regexp_matches(text, {_s(fixed.QUOTED_SPEECH)}) AS protected FROM chunks),
gr AS (SELECT doc_id, text, min(idx) AS first, min(score) AS score, sum(n_chars) AS n FROM sc WHERE NOT protected GROUP BY doc_id, text),
gn AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY score, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY doc_id) * 0.3 AS need FROM gr),
dropped AS (SELECT doc_id, idx FROM sc SEMI JOIN (SELECT * FROM gn WHERE before < need) g ON sc.doc_id = g.doc_id AND sc.text = g.text WHERE NOT protected)"""
_CR = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"

SQL = {
    "budget_drop": f"WITH {_SCORED} SELECT * FROM dropped",
    "restoration_rank": f"""WITH {_SCORED}, {_EDGES}, bw AS (SELECT doc_id, src AS idx, dst AS other, type, confidence FROM edges UNION ALL SELECT doc_id, dst, src, type, confidence FROM edges),
        e AS (SELECT bw.*, d2.idx IS NULL AS kept FROM bw SEMI JOIN dropped d ON bw.doc_id = d.doc_id AND bw.idx = d.idx LEFT JOIN dropped d2 ON bw.doc_id = d2.doc_id AND bw.other = d2.idx),
        s AS (SELECT doc_id, idx, round(sum(1 + confidence + CASE WHEN type IN ('QUALIFIES', 'CONTRADICTS', 'SUPERSEDES') THEN 1 ELSE 0 END + CASE WHEN kept THEN 0.5 ELSE 0 END), 6) AS score, count(*) FILTER (kept) AS k FROM e GROUP BY doc_id, idx)
        SELECT doc_id, idx, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM s WHERE k > 0 QUALIFY rank <= 8""",
    "assembled_texts": f"""WITH {_SCORED}, c AS (SELECT sc.*, d.idx IS NOT NULL AS gone FROM sc LEFT JOIN dropped d ON sc.doc_id = d.doc_id AND sc.idx = d.idx),
        i AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id, gone ORDER BY idx) AS island FROM c),
        p AS (SELECT doc_id, idx, text AS piece, 0 AS mark FROM i WHERE NOT gone UNION ALL SELECT doc_id, min(idx), '[' || count(*) || ' blocks left out: ' || CAST(sum(n_chars) AS BIGINT) || ' characters]', 1 FROM i WHERE gone GROUP BY doc_id, island)
        SELECT doc_id, sha256(string_agg(piece, chr(10) || chr(10) ORDER BY idx)) AS digest, sum(mark) AS n_markers FROM p GROUP BY doc_id""",
    "marker_coverage": f"""WITH m AS (SELECT doc_id, list_filter(['greenhouse', 'Sunday', 'no such marker'], lambda x: contains(text, x)) AS f, list_filter(['greenhouse', 'Sunday', 'no such marker'], lambda x: NOT contains(text, x)) AS g FROM {_T})
        SELECT doc_id, len(f) AS found, array_to_string(g, ',') AS missing, round(len(f) / 3, 4) AS recall FROM m""",
    "text_differences": f"WITH n AS (SELECT doc_id, text, {_normalized('text')} AS b FROM {_T}) SELECT CASE WHEN b = '' THEN 'only_left' WHEN text = b THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM n GROUP BY 1",
    "speech_signals": f"""WITH t AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ls, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS n_words,
        len(regexp_extract_all(text, '(?i)\\b(?:uh+|uhm+|umm+|hmm+|you know|i mean|basically|kinda|literally|so yeah)\\b')) AS hits, greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS stops FROM {_T}),
        f AS (SELECT *, len(list_distinct(list_filter(list_transform(ls, lambda x: lower(regexp_extract(x, {_s(speech.SPEAKER)}, 1))), lambda x: x <> ''))) AS speakers,
        len(list_filter(['tipo assim', 'quer dizer,', ' né?', 'you know,', 'basically,', 'literally,', 'thanks for watching', 'subtitles by'], lambda m: contains(lower(text), m))) AS fillers FROM t)
        SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches(x, {_s(speech.TIMING)}))) > 0 OR regexp_matches(text, {_s(speech.AUDIO_TAG)}) OR regexp_matches(text, {_s(speech.STAMP)}) OR speakers >= 2 OR fillers >= 2 AS speech,
        (hits >= 3 AND hits * 100 >= n_words * 3) OR (n_words >= 40 AND n_words / stops >= 30 AND NOT contains(text, chr(10))) AS dictated FROM f""",
    "line_range_pointers": f"""WITH r AS (SELECT session_id, result_id, min((message_index, pos)) AS at_pos, regexp_replace(max({_CR}), '\\n+\\z', '') AS t FROM results WHERE session_id IS NOT NULL AND len(text) >= 120 GROUP BY ALL),
        j AS (SELECT a.session_id, a.result_id, b.result_id AS points_to, b.at_pos, strpos(chr(10) || b.t || chr(10), chr(10) || a.t || chr(10)) AS p, a.t AS mine, b.t AS theirs FROM r a JOIN r b ON a.session_id = b.session_id AND a.result_id <> b.result_id AND b.at_pos > a.at_pos
          WHERE contains(chr(10) || b.t || chr(10), chr(10) || a.t || chr(10)) QUALIFY row_number() OVER (PARTITION BY a.session_id, a.result_id ORDER BY b.at_pos, b.result_id) = 1)
        SELECT session_id, result_id, points_to, len(theirs[:p - 1]) - len(replace(theirs[:p - 1], chr(10), '')) + 1 AS first_line, len(theirs[:p - 1]) - len(replace(theirs[:p - 1], chr(10), '')) + 1 + len(mine) - len(replace(mine, chr(10), '')) AS last_line FROM j""",
    "identifier_features": """WITH r AS (SELECT session_id, result_id, min((message_index, pos)) AS at_pos, max(text) AS text FROM results WHERE session_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_pos, result_id) AS seq FROM r),
        k0 AS (SELECT session_id, result_id, seq, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./~@-]{6,}'), lambda w: regexp_replace(w, '[./-]+$', '')), lambda w: len(w) >= 6 AND (regexp_matches(w, '[/_.]') OR (regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]')) OR regexp_matches(w, '[a-z][A-Z]'))))) AS key FROM s),
        k AS (SELECT *, max(seq) OVER (PARTITION BY session_id, key) AS last, count(*) OVER (PARTITION BY session_id, key) AS df FROM k0)
        SELECT session_id, result_id, count(*) AS n_keys, count(*) FILTER (last > seq) AS later_refs, count(*) FILTER (last = seq AND df > 1) AS latest, count(*) FILTER (df = 1) AS alone FROM k GROUP BY ALL""",
}
