"""Requests and their looks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import fixed
from lakeweave.operators import documents as D, intake as I
from lakeweave.operators.segments import ASK
from lakeweave.plans import document_queries as Q, more_queries as M
from lakeweave.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return D.filled(table(spark, folder, "documents"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, folder).select("doc_id", I.intake_language(t).alias("intake"), I.log_language(t).alias("log"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    d = table(spark, folder, "sessions").select(F.col("session_id").alias("id"), F.coalesce("goal", F.lit("")).alias("text")).distinct().unionByName(_docs(spark, folder).select(F.col("doc_id").cast("string").alias("id"), "text"))
    return d.select("id", I.ambiguity(t, F.lit("")).alias("ambiguity"), I.calculation(t).alias("value"), I.ask_count(t).alias("n_asks"), I.is_injected(t).alias("injected"))


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    """Every document on four axes: the question's share it holds, repeated paragraphs, turns of meaning, and how much text there is to go by."""
    docs = table(spark, folder, "documents")
    rel = D.mechanical_score(docs, Q.QUESTION).select("doc_id", F.col("score").alias("relevance"))
    rec = D.recommendation(docs).select("doc_id", "duplicate_ratio", (F.col("saved_percent") / 100).alias("savings"))
    t = F.col("text")
    d = _docs(spark, folder).select("doc_id", F.when(t.rlike(fixed.NEGATION) & t.rlike(fixed.QUALIFIER), 0.7).otherwise(0.0).alias("risk"), F.when(F.length("text") < 80, 0.2).when(F.length("text") < 200, 0.4).otherwise(1.0).alias("confidence"), (F.size(F.split("text", "```")) % 2 == 0).alias("open_fence"))
    j = d.join(rel, "doc_id").join(rec, "doc_id")
    verdict = I.assessment(F.col("relevance"), F.lit(0.0), F.lit(0.0), F.col("risk"), F.col("duplicate_ratio"), F.col("confidence"))
    return j.select("doc_id", verdict.alias("decision"), I.noise(F.col("duplicate_ratio"), F.col("savings"), F.col("open_fence")).alias("noise"))


def objectives(spark: SparkSession, folder: str) -> DataFrame:
    return I.objectives(table(spark, folder, "documents").select("doc_id", "text"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "calls").filter("session_id is not null and path is not null").select("session_id", F.regexp_extract("path", r"([^/]+)/*$", 1).alias("ref")).filter("ref <> ''")
    r = table(spark, folder, "results").filter("session_id is not null and text is not null").groupBy("session_id", "result_id").agg(F.max("text").alias("text"))
    return I.whole_mentions(r.select("session_id", "text"), c, ["session_id"])


def grams(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", I.hashed_grams("text").alias("grams"))


QUERIES = {"request_languages": languages, "request_scores": requests, "document_assessments": assessments, "main_objectives": objectives, "whole_mentions": mentions, "hashed_grams": grams}

_s = Q._s
_lst = lambda values: ", ".join(_s(v) for v in values)
_ACCENT, _OTHER = "[ãõçáéíóúâêôà]", r"[^\x00-\x7F]"


def _holds(words: tuple[str, ...]) -> str:
    return f"regexp_matches(text, {_s('(?i)(?:^|[^a-z0-9_-])(?:' + '|'.join(w.replace(' ', chr(92) + 's+') for w in words) + ')(?:$|[^a-z0-9_-])')})"


SQL = {
    "request_languages": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '<[A-Z]+>', ' ', 'g') AS plain FROM documents),
        v AS (SELECT doc_id, list_transform(regexp_extract_all(plain, '[\\p{{L}}\\p{{M}}]+|[0-9]+'), lambda w: lower(w)) AS ws FROM t), h AS (SELECT doc_id, len(ws) AS n, {Q._LANG_HITS} FROM v),
        r AS (SELECT doc_id, n, list_sort([{{'n': pt, 'o': 0, 't': 'pt'}}, {{'n': es, 'o': -1, 't': 'es'}}, {{'n': fr, 'o': -2, 't': 'fr'}}, {{'n': de, 'o': -3, 't': 'de'}}], 'DESC') AS r FROM h),
        vote AS (SELECT doc_id, CASE WHEN n >= 12 AND r[1].n >= 3 AND r[1].n > r[2].n * 1.5 THEN r[1].t END AS tag FROM r),
        a AS (SELECT doc_id, plain, regexp_extract_all(lower(text), '\\p{{L}}+(?:''[a-z]+)?') AS iw, list_concat(regexp_extract_all(lower(plain), '\\p{{L}}{{2,}}'), regexp_extract_all(lower(plain), '\\b([oa])\\b', 1)) AS lw FROM t),
        b AS (SELECT *, len(list_filter(lw, lambda w: w IN ({_lst(I.PT_HINTS)}) OR regexp_matches(w, {_s(I.PT_ENDINGS)}) OR regexp_matches(w, {_s(_OTHER)}))) AS pt, len(list_filter(lw, lambda w: w IN ({_lst(I.EN_HINTS)}))) AS en FROM a)
        SELECT b.doc_id, CASE WHEN len(list_filter(iw, lambda w: w IN ({_lst(I.PT_STOP)}) OR regexp_matches(w, '{_ACCENT}'))) > len(list_filter(iw, lambda w: w IN ({_lst(I.EN_STOP)}))) THEN 'pt' ELSE 'en' END AS intake,
        coalesce(tag, CASE WHEN len(lw) = 0 THEN NULL WHEN pt > en THEN 'pt' WHEN en > pt OR NOT regexp_matches(plain, {_s(_OTHER)}) THEN 'en' END) AS log FROM b JOIN vote USING (doc_id)""",
    "request_scores": f"""WITH t AS (SELECT DISTINCT session_id AS id, coalesce(goal, '') AS text FROM sessions UNION ALL SELECT CAST(doc_id AS VARCHAR), coalesce(text, '') FROM documents),
        c AS (SELECT *, TRY_CAST(regexp_extract(text, {_s(I.CALCULATION)}, 1) AS DOUBLE) AS a, lower(regexp_extract(text, {_s(I.CALCULATION)}, 2)) AS sign, TRY_CAST(regexp_extract(text, {_s(I.CALCULATION)}, 3) AS DOUBLE) AS b, regexp_extract_all(regexp_replace(text, {_s('(' + ASK + ')')}, '\\1' || chr(1), 'g'), '\\S+') AS ws FROM t),
        p AS (SELECT *, list_filter(list_transform(ws, lambda w, i: CASE WHEN contains(w, chr(1)) THEN i END), lambda i: i IS NOT NULL) AS places FROM c)
        SELECT id, least(1.0, round(CASE WHEN {_holds(I.DOUBT)} THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(text, {_s(I.SAYS_BUT_SAYS)}) THEN 0.25 ELSE 0 END + CASE WHEN NOT contains(text, '?') AND len(regexp_extract_all(text, '\\S+')) < 5 THEN 0.25 ELSE 0 END + CASE WHEN {_holds(I.CONFLICT)} THEN 0.4 ELSE 0 END, 4)) AS ambiguity,
        CASE WHEN sign = '+' THEN a + b WHEN sign = '-' THEN a - b WHEN sign IN ('*', 'x', '×') THEN a * b WHEN sign = '/' AND b <> 0 THEN a / b END AS value,
        CAST(len(list_filter(places, lambda x, i: i = 1 OR x - places[i - 1] > 4)) AS INTEGER) AS n_asks, {' OR '.join(f"starts_with(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13)), {_s(p)})" for p in I.INJECTED)} AS injected FROM p""",
    "document_assessments": f"""WITH rel AS ({Q.SQL['mechanical_score']}), rec AS ({Q.SQL['cleaning_recommendation']}),
        d AS (SELECT doc_id, CASE WHEN regexp_matches(text, {_s(fixed.NEGATION)}) AND regexp_matches(text, {_s(fixed.QUALIFIER)}) THEN 0.7 ELSE 0.0 END AS risk, CASE WHEN len(text) < 80 THEN 0.2 WHEN len(text) < 200 THEN 0.4 ELSE 1.0 END AS confidence, len(string_split(text, '```')) % 2 = 0 AS open_fence FROM {Q._T}),
        j AS (SELECT d.*, rel.score AS relevance, duplicate_ratio, saved_percent / 100 AS savings FROM d JOIN rel USING (doc_id) JOIN rec USING (doc_id)),
        f AS (SELECT *, CASE WHEN risk >= 0.7 THEN 'KEEP' WHEN duplicate_ratio >= 0.7 THEN 'DROP' WHEN relevance >= 0.4 THEN 'KEEP' WHEN relevance >= 0.2 THEN 'TRIM' ELSE 'DROP' END AS first FROM j)
        SELECT doc_id, CASE WHEN confidence < 0.3 THEN 'KEEP' WHEN confidence < 0.5 AND first = 'DROP' THEN 'TRIM' ELSE first END AS decision,
        least(1.0, round(CASE WHEN duplicate_ratio > 0.1 THEN least(duplicate_ratio, 0.5) ELSE 0 END + CASE WHEN savings > 0.15 THEN least(savings, 0.5) ELSE 0 END + CASE WHEN open_fence THEN 0.2 ELSE 0 END, 4)) AS noise FROM f""",
    "main_objectives": f"""WITH s AS ({M.SQL['sentence_roles']}), c AS (SELECT *, len(regexp_extract_all(sentence, {_s('(' + ASK + ')')})) AS cues, list_transform(list_filter(regexp_extract_all(lower(sentence), '\\p{{L}}+'), lambda w: len(w) >= 4 AND w NOT IN ({_lst((*I.EN_STOP, *I.PT_STOP))})), lambda w: w[:5]) AS stems FROM s),
        b AS (SELECT doc_id, topic, sum(cues) AS cues, bool_or(regexp_matches(sentence, {_s(I.PRIORITY)})) AS marked, arg_min(sentence, idx) FILTER (role = 'ask') AS ask, arg_min(sentence, idx) AS first, flatten(list(stems)) AS stems FROM c GROUP BY ALL),
        n AS (SELECT *, max(topic) OVER (PARTITION BY doc_id) AS n_blocks FROM b), r AS (SELECT *, topic = n_blocks AND n_blocks > 1 AND regexp_matches(first, {_s(I.RECAP)}) AS recap FROM n),
        w AS (SELECT doc_id, unnest(list_distinct(stems)) AS term FROM r WHERE recap), pre AS (SELECT r.doc_id, r.topic, r.stems, len(r.stems) AS len, avg(len(r.stems)) OVER (PARTITION BY r.doc_id) AS avg_len, count(*) OVER (PARTITION BY r.doc_id) AS n FROM r SEMI JOIN w USING (doc_id) WHERE topic < n_blocks),
        tf AS (SELECT doc_id, topic, len, avg_len, n, term, count(*) AS f FROM (SELECT *, unnest(stems) AS term FROM pre) SEMI JOIN w USING (doc_id, term) GROUP BY ALL), dfs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM tf),
        met AS (SELECT doc_id, topic, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg_len))) AS bm25 FROM dfs GROUP BY ALL),
        k AS (SELECT r.*, bm25, max(bm25) OVER (PARTITION BY r.doc_id) AS mb, max(cues) OVER (PARTITION BY r.doc_id) AS mc FROM r LEFT JOIN met USING (doc_id, topic)),
        z AS (SELECT *, round(0.5 * CAST(marked AS INTEGER) + 0.5 * CASE WHEN recap THEN 1.0 WHEN mb > 0 THEN coalesce(bm25 / mb, 0) ELSE 0 END + 0.5 * CASE WHEN mc > 0 THEN cues / mc ELSE 0 END, 6) AS score FROM k)
        SELECT DISTINCT ON (doc_id) doc_id, topic, score, n_blocks, ask AS objective FROM z WHERE ask IS NOT NULL ORDER BY doc_id, score DESC, topic""",
    "whole_mentions": """WITH c AS (SELECT DISTINCT session_id, regexp_extract(path, '([^/]+)/*$', 1) AS ref FROM calls WHERE session_id IS NOT NULL AND path IS NOT NULL),
        r AS (SELECT session_id, result_id, max(text) AS text FROM results WHERE session_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL), w AS (SELECT session_id, result_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.-]+'))) AS w FROM r),
        h AS (SELECT DISTINCT session_id, result_id, w[:i] AS ref FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE i = len(w) OR w[i + 1] = '.') SELECT session_id, ref, count(*) AS n FROM h SEMI JOIN c USING (session_id, ref) WHERE ref <> '' GROUP BY ALL""",
}
