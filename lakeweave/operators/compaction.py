"""Budgeted compaction: what to drop, what to put back, and the text that is left.

Works on the chunk table of :mod:`documents`; texts join in only where a text is put
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X
from lakeweave.operators import documents as D


def scored(df: DataFrame, question: str) -> DataFrame:
    """(doc_id, idx, n_chars, score, protected, key, text): chunks with their share of the question's terms.

    Short chunks and chunks that quote somebody are protected.
    """
    q = X.terms(F.lit(question))
    score = F.bround(F.least(F.lit(1.0), F.size(F.array_intersect(X.terms(F.col("text")), q)) / F.greatest(F.lit(1), F.least(F.lit(6), F.size(q)))), 2)
    return D.chunks(df).select("doc_id", "idx", F.length("text").alias("n_chars"), score.alias("score"), ((F.length("text") < 80) | F.col("text").rlike(fixed.QUOTED_SPEECH)).alias("protected"), F.sha2("text", 256).alias("key"), "text", "char_start", "char_end")


def budget_drop(chunks: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, idx): the lowest scores, until ``share`` of the droppable characters is reached.

    Ties go by place; equal chunks go together, at their first one's place; the pick that
    crosses the line is the last.
    """
    free = chunks.filter("not protected")
    g = free.groupBy("doc_id", "key").agg(F.min("idx").alias("first"), F.min("score").alias("score"), F.sum("n_chars").alias("n"))
    w = W.partitionBy("doc_id")
    before = F.coalesce(F.sum("n").over(w.orderBy("score", "first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("before", before).withColumn("need", F.sum("n").over(w) * F.lit(share))
    return free.join(g.filter("before < need").select("doc_id", "key"), ["doc_id", "key"], "left_semi").select("doc_id", "idx")


def restore(edges: DataFrame, dropped: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, idx, rank): dropped chunks to put back, by how kept chunks hang on them.

    rank counts an edge as 1, adds its confidence, 1 for edges other than SUPPORTS and
    DUPLICATES and a half for an edge to a kept chunk; ties go by place; n at most.
    """
    both = D.both_ways(edges, "src", "dst", "type", "confidence")
    e = both.join(dropped, ["doc_id", "idx"], "left_semi").join(dropped.select("doc_id", F.col("idx").alias("other"), F.lit(True).alias("gone")), ["doc_id", "other"], "left")
    strong = F.col("type").isin("QUALIFIES", "CONTRADICTS", "SUPERSEDES", "DEPENDS_ON")
    s = e.groupBy("doc_id", "idx").agg(F.round(F.sum(1 + F.col("confidence") + strong.cast("int") + F.when(F.col("gone").isNull(), 0.5).otherwise(0.0)), 6).alias("score"), F.count_if(F.col("gone").isNull()).alias("kept_edges"))
    s = s.filter("kept_edges > 0").withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "idx")))
    return s.filter(F.col("rank") <= n).select("doc_id", "idx", "score", "rank")


def assembled(chunks: DataFrame, dropped: DataFrame) -> DataFrame:
    """(doc_id, text, n_markers): kept chunks in order; a run of dropped ones is one marker with its size."""
    c = chunks.join(dropped.withColumn("gone", F.lit(True)), ["doc_id", "idx"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    by = W.partitionBy("doc_id").orderBy("idx")
    c = c.withColumn("island", F.col("idx") - F.row_number().over(W.partitionBy("doc_id", "gone").orderBy("idx"))).withColumn("n", F.count("*").over(by))
    runs = c.filter("gone").groupBy("doc_id", "island").agg(F.min("idx").alias("idx"), F.count("*").alias("k"), F.sum("n_chars").alias("chars"))
    marks = runs.select("doc_id", "idx", F.format_string("[%d blocks left out: %d characters]", "k", "chars").alias("piece"), F.lit(1).alias("mark"))
    kept = c.filter("not gone").select("doc_id", "idx", F.col("text").alias("piece"), F.lit(0).alias("mark"))
    out = kept.unionByName(marks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("p"), F.sum("mark").alias("n_markers"))
    return out.select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("text"), "n_markers")


def coverage(texts: DataFrame, markers: list[str], key: str = "doc_id") -> DataFrame:
    """(key, found, missing, recall): which of the markers a text holds."""
    m = F.array(*[F.lit(x) for x in markers])
    found = F.filter(m, lambda x: F.contains(F.col("text"), x))
    return texts.select(key, F.size(found).alias("found"), F.array_join(F.array_except(m, found), ",").alias("missing"), F.round(F.size(found) / F.greatest(F.lit(1), F.size(m)), 4).alias("recall"))


def differences(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(status, n): how two sets of texts differ: same, changed, only_left, only_right."""
    l, r = left.select(key, F.sha2("text", 256).alias("a")), right.select(key, F.sha2("text", 256).alias("b"))
    both = l.join(r, key, "full_outer")
    status = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


# --- results that stand, as whole lines, in a later result of their session ------------------


def line_range_pointers(results: DataFrame, least: int = 120) -> DataFrame:
    """(session_id, result_id, points_to, first_line, last_line): the nearest later result that holds a result's lines.

    Candidates meet by the hash of the result's longest line, so no two texts are compared
    that have no such line in common; the comparison is exact.
    """
    r = results.filter(F.col("session_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= least))
    r = r.groupBy("session_id", "result_id").agg(F.min(F.struct("message_index", "pos")).alias("at"), F.max(F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))).alias("t"))
    r = r.select("session_id", "result_id", "at", F.split(F.regexp_replace("t", r"\n+\z", ""), "\n").alias("ls"))
    key = lambda c: F.xxhash64(c)
    # the longest line names a text best: fewest texts meet by chance
    long_at = F.array_position(F.transform("ls", lambda x: F.length(x)), F.array_max(F.transform("ls", lambda x: F.length(x)))).cast("int")
    small = r.withColumn("k", long_at).select("session_id", "result_id", "at", "k", F.size("ls").alias("n"), key(F.element_at("ls", F.col("k"))).alias("h"))
    lines = r.select("session_id", F.col("result_id").alias("other"), F.col("at").alias("other_at"), F.size("ls").alias("m"), F.posexplode("ls").alias("i", "line"))
    lines = lines.select("session_id", "other", "other_at", "m", "i", key(F.col("line")).alias("h"))
    meet = small.join(lines, ["session_id", "h"]).filter((F.col("other_at") > F.col("at")) & (F.col("other") != F.col("result_id")))
    meet = meet.withColumn("first", F.col("i") - F.col("k") + 2).filter((F.col("first") >= 1) & (F.col("first") + F.col("n") - 1 <= F.col("m")))
    a = r.select("session_id", "result_id", F.col("ls").alias("mine"))
    b = r.select("session_id", F.col("result_id").alias("other"), F.col("ls").alias("theirs"))
    same = meet.join(a, ["session_id", "result_id"]).join(b, ["session_id", "other"]).filter(F.slice("theirs", F.col("first"), F.col("n")) == F.col("mine"))
    best = F.row_number().over(W.partitionBy("session_id", "result_id").orderBy("other_at", "other", "first"))
    return same.withColumn("r", best).filter("r = 1").select("session_id", "result_id", F.col("other").alias("points_to"), F.col("first").alias("first_line"), (F.col("first") + F.col("n") - 1).alias("last_line"))


# --- identifiers that later parts hold again -------------------------------------------------


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a text: six characters or more, of names, paths and numbers mixed with letters."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./~@-]{6,}"), 0)
    mixed = lambda w: w.rlike(r"[/_.]") | (w.rlike(r"[A-Za-z]") & w.rlike(r"[0-9]")) | w.rlike(r"[a-z][A-Z]")
    return F.array_distinct(F.filter(F.transform(found, lambda w: F.regexp_replace(w, r"[./-]+$", "")), lambda w: (F.length(w) >= 6) & mixed(w)))


def key_features(results: DataFrame) -> DataFrame:
    """(session_id, result_id, n_keys, later_refs, latest, alone): identifiers of a result in its session.

    later_refs: held again later; latest: held here last, and before; alone: held here only.
    """
    r = results.filter(F.col("session_id").isNotNull() & F.col("text").isNotNull())
    r = r.groupBy("session_id", "result_id").agg(F.min(F.struct("message_index", "pos")).alias("at"), F.max("text").alias("text"))
    r = r.withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("at", "result_id")))
    k = r.select("session_id", "result_id", "seq", F.explode(identifiers(F.col("text"))).alias("key"))
    w = W.partitionBy("session_id", "key")
    k = k.withColumn("last", F.max("seq").over(w)).withColumn("df", F.count("*").over(w))
    return k.groupBy("session_id", "result_id").agg(F.count("*").alias("n_keys"), F.count_if(F.col("last") > F.col("seq")).alias("later_refs"), F.count_if((F.col("last") == F.col("seq")) & (F.col("df") > 1)).alias("latest"), F.count_if(F.col("df") == 1).alias("alone"))
