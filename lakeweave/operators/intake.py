"""What a text asks for: its language, its requests, its main objective, and how sure one can be of it.

All of it is built from columns of the JVM but the hashed letter groups; texts stay in their
rows, and only sentences are laid out where blocks of them are weighed.

Defined results: null texts are empty; a text without sentences has no objective.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import text as X
from lakeweave.operators.segments import ASK, sentences

# Function words of Portuguese and English, for short requests.
PT_STOP = (
    "o", "os", "de", "do", "da", "dos", "das", "que", "não", "é", "uma", "para", "com", "em", "na", "nos", "nas", "eu", "você", "isso", "mas", "por", "ele", "ela", "está", "tá", "foi",
    "como", "mais", "ou", "também", "já", "aí", "né", "tipo", "então", "esse", "essa", "aquele", "assim", "coisa", "sei", "aqui", "agora", "depois", "seu", "sua", "meu", "minha",
    "nada", "tudo", "quando", "onde", "porque", "pra", "pro", "ao", "pelo", "pela", "tem", "vai",
)
EN_STOP = (
    "the", "to", "of", "and", "is", "it", "in", "that", "you", "for", "on", "with", "this", "not", "be", "are", "i", "we", "my", "your", "can", "what", "how", "if", "or", "but",
    "was", "at", "from", "just", "should", "would", "which", "there", "they", "have", "has", "an", "all", "any", "some", "about", "when", "where", "because", "will", "it's", "don't",
)
# Hints for the language of a logged request.
PT_HINTS = (
    "qual", "quais", "o", "os", "as", "de", "do", "da", "dos", "das", "no", "na", "nos", "nas", "em", "um", "uma", "para", "com", "por", "pelo", "pela", "mais", "menos", "não", "nao", "é",
    "são", "sao", "que", "como", "último", "ultimo", "última", "ultima", "recente", "hoje", "ontem", "valor", "peso", "paciente", "consulta",
)
EN_HINTS = (
    "the", "an", "of", "and", "to", "for", "in", "on", "at", "is", "are", "was", "what", "which", "how", "why", "when", "where", "who", "latest", "last", "most", "recent", "with", "from",
    "my", "our", "this", "that", "show", "find", "get", "list",
)
PT_ENDINGS = "(?:ção|ções|mento|mentos|agem|dade|dades)$"
# Words of doubt and of conflict.
DOUBT = ("maybe", "ambiguous", "unclear", "unknown", "not enough context", "cannot determine", "conflicting", "inconsistent")
CONFLICT = ("ignore previous", "disregard above", "instead answer", "contradict")
SAYS_BUT_SAYS = r"(?is)\b(?:say|says|state|states|report|reports)\b.+\b(?:but|while|however)\b.+\b(?:say|says|state|states|report|reports)\b"
CALCULATION = r"(?i)(-?\d+(?:\.\d+)?)\s*([+\-*/×x])\s*(-?\d+(?:\.\d+)?)"
# Cues that rank a request, and that sum one up.
PRIORITY = (
    r"(?i)\b(?:main thing|most important|the priority|top priority|priority one|what (?:really )?matters|above all|before anything else|the big one|the key (?:thing|one)|most urgent|urgent|crucial|essential|care about most|one thing today|matters most"
    r"|o\s+(?:mais\s+)?importante|o\s+principal|a\s+principal|prioridade|o\s+que\s+(?:mais\s+)?importa|acima de tudo|antes de (?:qualquer|tudo)|o\s+foco|mais urgente|urgente|essencial)"
)
RECAP = r"(?i)^\W*(?:to sum up|in short|to recap|bottom line|long story short|at the end of the day|just to be clear|coming back to|in summary|so,? basically|resumindo|em resumo|recapitulando|no fim das contas|pra fechar|deixando claro|resumo)\b"
MERGE_WINDOW = 4
# What tools put into user messages, and what is no prompt therefore.
INJECTED = (
    "<system-reminder", "<task-notification", "<command-", "<local-command-", "<bash-", "<user-prompt-submit-hook", "<ci-monitor-event", "[Request interrupted by user",
    "# AGENTS.md instructions", "<environment_context", "<user_instructions", "<user_action", "<turn_aborted", "<guardian_tool_descriptions", "<image", "</image",
)


def is_injected(text: Column) -> Column:
    """Whether a user's text is context that a tool put there."""
    t = F.regexp_replace(text, r"\A\s+", "")
    return reduce(lambda a, b: a | b, [t.startswith(p) for p in INJECTED])


def intake_language(text: Column) -> Column:
    """pt or en by function words; a word with a Portuguese accent counts for pt, ties are en."""
    ws = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:'[a-z]+)?"), 0)
    pt = F.size(F.filter(ws, lambda w: w.isin(*PT_STOP) | w.rlike("[ãõçáéíóúâêôà]")))
    return F.when(pt > F.size(F.filter(ws, lambda w: w.isin(*EN_STOP))), "pt").otherwise("en")


def log_language(text: Column) -> Column:
    """The long-text vote; else pt or en by hints; null without words or where nothing tells."""
    t = F.regexp_replace(text, "<[A-Z]+>", " ")
    low = F.lower(t)
    ws = F.concat(F.regexp_extract_all(low, F.lit(r"\p{L}{2,}"), 0), F.regexp_extract_all(low, F.lit(r"\b([oa])\b"), 1))
    pt = F.size(F.filter(ws, lambda w: w.isin(*PT_HINTS) | w.rlike(PT_ENDINGS) | w.rlike(r"[^\x00-\x7F]")))
    en = F.size(F.filter(ws, lambda w: w.isin(*EN_HINTS)))
    short = F.when(F.size(ws) == 0, None).when(pt > en, "pt").when((en > pt) | ~t.rlike(r"[^\x00-\x7F]"), "en")
    return F.coalesce(X.language_vote(t), short)


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?i)(?:^|[^a-z0-9_-])(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")(?:$|[^a-z0-9_-])")


def ambiguity(instruction: Column, context: Column) -> Column:
    """0 to 1: words of doubt 0.35, one says and another says 0.25, a short request without question mark 0.25, words of conflict 0.4."""
    both = F.concat_ws("\n", instruction, context)
    short = ~F.contains(instruction, F.lit("?")) & (F.size(F.regexp_extract_all(instruction, F.lit(r"\S+"), 0)) < 5)
    parts = ((_holds(both, DOUBT), 0.35), (both.rlike(SAYS_BUT_SAYS), 0.25), (short, 0.25), (_holds(both, CONFLICT), 0.4))
    return F.least(F.lit(1.0), F.round(sum(F.when(c, w).otherwise(0.0) for c, w in parts), 4))


def noise(duplicate_ratio: Column, savings_ratio: Column, unbalanced: Column) -> Column:
    """0 to 1: repeated paragraphs above a tenth, savings above 0.15 (each a half at most), and 0.2 for an open fence."""
    part = lambda x, least: F.when(x > least, F.least(x, F.lit(0.5))).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(part(duplicate_ratio, 0.1) + part(savings_ratio, 0.15) + F.when(unbalanced, 0.2).otherwise(0.0), 4))


def assessment(relevance: Column, necessity: Column, dependency_risk: Column, semantic_risk: Column, redundancy: Column, confidence: Column, threshold: float = 0.4) -> Column:
    """KEEP, TRIM or DROP. Risk and need keep whatever the relevance; redundancy without need drops; the rest goes by relevance; doubt moves a step towards keeping."""
    first = (
        F.when((dependency_risk >= 0.5) | (semantic_risk >= 0.7) | (necessity >= 0.7), "KEEP")
        .when((redundancy >= 0.7) & (necessity <= 0.3), "DROP")
        .when(relevance >= threshold, "KEEP")
        .when(relevance >= threshold / 2, "TRIM")
        .otherwise("DROP")
    )
    return F.when(confidence < 0.3, "KEEP").when((confidence < 0.5) & (first == "DROP"), "TRIM").otherwise(first)


def calculation(text: Column) -> Column:
    """The value of the first calculation of two numbers in a text, null without one and for a division by 0."""
    part = lambda i: F.regexp_extract(text, CALCULATION, i)
    a, b, sign = part(1).try_cast("double"), part(3).try_cast("double"), F.lower(part(2))
    return F.when(sign == "+", a + b).when(sign == "-", a - b).when(sign.isin("*", "x", "×"), a * b).when((sign == "/") & (b != 0), a / b)


def ask_count(text: Column) -> Column:
    """How many requests a text makes: cues within four words of one another are one."""
    words = F.regexp_extract_all(F.regexp_replace(text, "(" + ASK + ")", "$1\x01"), F.lit(r"\S+"), 0)
    at = F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit("\x01")), i)), lambda i: i.isNotNull())
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-1000).alias("last")), lambda s, i: F.struct((s["n"] + F.when(i - s["last"] > MERGE_WINDOW, 1).otherwise(0)).alias("n"), i.alias("last")), lambda s: s["n"])


def objectives(df: DataFrame) -> DataFrame:
    """(doc_id, topic, score, n_blocks, objective): the topic block that holds a document's main request.

    Of the blocks with a request the one with the greatest score, ties to the earlier: a half each
    for a cue of priority, for its number of cues and for being summed up at the end (BM25 of the
    closing block's stems against the blocks before), as shares of the document's greatest.
    """
    s = sentences(df)
    cues = X.count_matches(F.col("sentence"), ASK)
    stems = F.transform(F.filter(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\p{L}+"), 0), lambda w: (F.length(w) >= 4) & ~w.isin(*EN_STOP, *PT_STOP)), lambda w: F.substring(w, 1, 5))
    s = s.withColumn("cues", cues).withColumn("stems", stems)
    asks = F.when(F.col("role") == "ask", F.struct("idx", "sentence"))
    b = s.groupBy("doc_id", "topic").agg(F.sum("cues").alias("cues"), F.bool_or(F.col("sentence").rlike(PRIORITY)).alias("marked"), F.min(asks).alias("ask"), F.min(F.struct("idx", "sentence")).alias("first"), F.flatten(F.collect_list("stems")).alias("stems"))
    doc = W.partitionBy("doc_id")
    b = b.withColumn("n_blocks", F.max("topic").over(doc)).withColumn("recap", (F.col("topic") == F.col("n_blocks")) & (F.col("n_blocks") > 1) & F.col("first.sentence").rlike(RECAP))
    last = b.filter("recap").select("doc_id", F.array_distinct("stems").alias("wanted"), "n_blocks")
    before = b.join(last.select("doc_id", "wanted"), "doc_id").filter("topic < n_blocks").withColumn("len", F.size("stems"))
    before = before.withColumn("avg_len", F.avg("len").over(doc)).withColumn("n", F.count("*").over(doc))
    tf = before.select("doc_id", "topic", "len", "avg_len", "n", F.explode(F.filter("stems", lambda w: F.array_contains(F.col("wanted"), w))).alias("term")).groupBy("doc_id", "topic", "len", "avg_len", "n", "term").agg(F.count("*").alias("f"))
    tf = tf.withColumn("df", F.count("*").over(W.partitionBy("doc_id", "term")))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * 2.5 / (F.col("f") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    met = tf.groupBy("doc_id", "topic").agg(F.sum(part).alias("bm25"))
    b = b.join(met, ["doc_id", "topic"], "left")
    scaled = lambda c: F.coalesce(F.when(F.max(c).over(doc) > 0, F.col(c) / F.max(c).over(doc)), F.lit(0.0))
    restated = F.when(F.col("recap"), 1.0).otherwise(scaled("bm25"))
    b = b.withColumn("score", F.round(0.5 * F.col("marked").cast("int") + 0.5 * restated + 0.5 * scaled("cues"), 6))
    best = F.row_number().over(doc.orderBy(F.desc("score"), "topic"))
    return b.filter("ask is not null").withColumn("r", best).filter("r = 1").select("doc_id", "topic", "score", "n_blocks", F.col("ask.sentence").alias("objective"))


# --- hashed letter groups and a linear judge over them ---------------------------------------

BUCKETS = 1 << 15


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def hashed_grams(s: pd.Series) -> pd.Series:
    """Sorted buckets of a text's letter groups (2 to 5 of each word, with its ends), words and pairs of words."""
    import re

    def one(t: str | None) -> list[int]:
        ws = re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").lower())
        found = {"c" + p[i : i + n] for w in ws for p in (f" {w} ",) for n in range(2, 6) for i in range(len(p) - n + 1)}
        found |= {"w" + w for w in ws} | {f"b{a} {b}" for a, b in zip(ws, ws[1:])}
        return sorted({zlib.crc32(g.encode()) % BUCKETS for g in found or {"<empty>"}})

    return s.map(one)


def judged(df: DataFrame, weights: np.ndarray, bias: np.ndarray, labels: list[str], grams: str = "grams") -> DataFrame:
    """The rows with ``label`` and ``probability``: softmax of a linear judge (buckets x labels) over binary grams of unit length."""

    @F.pandas_udf("label string, probability double")
    def judge(s: pd.Series) -> pd.DataFrame:
        z = np.stack([bias + (weights[np.asarray(g, int)].sum(0) / np.sqrt(len(g)) if len(g) else 0) for g in s]) if len(s) else np.zeros((0, len(labels)))
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        p = p / p.sum(1, keepdims=True) if len(z) else p
        return pd.DataFrame({"label": [labels[i] for i in p.argmax(1)] if len(p) else [], "probability": p.max(1) if len(p) else []})

    j = df.withColumn("j", judge(grams))
    return j.select(*df.columns, "j.label", "j.probability")


# --- names of files in texts -------------------------------------------------------------------


def whole_mentions(texts: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, n): how many of the texts name a file (keys, ref) as a whole word.

    The name may stand behind a slash and before a full stop, not inside a longer name. Every
    word is laid out with its beginnings up to each point, so names meet by equality.
    """
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w.-]+"), 0))
    cuts = lambda w: F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: (i == F.length(w)) | (F.substring(w, i + 1, 1) == "."))
    heads = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(cuts(w), lambda i: F.substring(w, F.lit(1), i)))))
    t = texts.select(*keys, F.explode(heads).alias("ref"))
    return t.join(refs.select(*keys, "ref").distinct(), [*keys, "ref"]).groupBy(*keys, "ref").agg(F.count("*").alias("n"))
