"""Compaction of documents in one chain: blocks, protection, scores, budget, dependencies, sufficiency, assembly.

Blocks and the gaps between them are the document, character for character, so what is
kept is kept to the byte: a document from which nothing is taken comes out unchanged. Blocks
are written once and every step reads that copy; decisions are rows of ids.

Defined results: null and empty texts have no blocks and stay as they are; a question without
terms takes nothing out; ties go to the earlier block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X
from lakeweave.operators import compaction as C, documents as D, segments as G
from lakeweave.sources.tables import materialize

STRONG = ("QUALIFIES", "CONTRADICTS", "SUPERSEDES", "DEPENDS_ON")
# What a decision is told as.
REASONS = {
    "standalone_instruction": "text shaped like an instruction of its own, left out of what is handed on",
    "short_block": "too short to judge",
    "prefix": "before the place up to which nothing changes",
    "keep_pattern": "matches a pattern that is to be kept",
    "tail": "one of the newest blocks",
    "quoted_speech": "quotes what somebody said",
    "scored": "kept by its score",
    "dependency": "a kept block depends on it",
    "missing_evidence": "holds a term of the question that nothing kept holds",
    "low_score": "among the lowest scores, within the share to be taken out",
}


def score_bucket(score: Column) -> Column:
    """Tenths, half up."""
    return F.floor(score * 10 + 0.5) / 10


def parts(df: DataFrame, question: str, keep: str | None = None, prefix_chars: int = 0, tail_blocks: int = 0) -> DataFrame:
    """The blocks and gaps of all documents with score, share of the question's terms, and why a block is protected or left out."""
    q = X.terms(F.lit(question))
    text = F.coalesce("text", F.lit(""))
    b = G.blocks(df.select("doc_id", "text")).withColumn("is_block", F.col("block_id").isNotNull())
    hits = F.array_intersect(X.terms(text), q)
    score = F.when(F.size(q) == 0, 1.0).otherwise(F.bround(F.least(F.lit(1.0), F.size(hits) / F.greatest(F.lit(1), F.least(F.lit(6), F.size(q)))), 2))
    from_end = F.max(F.when(F.col("is_block"), F.col("idx"))).over(W.partitionBy("doc_id")) - F.col("idx")
    shaped = text.rlike(fixed.STANDALONE_INSTRUCTION) & ~text.rlike(fixed.QUOTED_SPEECH)
    why = (
        F.when(~F.col("is_block"), None)
        .when(shaped, "standalone_instruction")
        .when(F.length(text) < G.BLOCK_LEAST, "short_block")
        .when(F.col("char_start") < prefix_chars, "prefix")
        .when(text.rlike(keep) if keep else F.lit(False), "keep_pattern")
        .when(from_end < tail_blocks, "tail")
        .when(text.rlike(fixed.QUOTED_SPEECH), "quoted_speech")
    )
    first = F.first("block_id").over(W.partitionBy("doc_id", F.sha2(F.trim(text), 256)).orderBy("idx"))
    b = b.withColumns({"hits": hits, "score": score, "why": why, "n_chars": F.length(text), "duplicate_of": F.when(F.col("is_block") & (first != F.col("block_id")), first), "key": F.sha2(text, 256)})
    return b.drop("is_protected", "reason", "char_end")


def decide(p: DataFrame, question: str, share: float = 0.3, most_restored: int = 8) -> DataFrame:
    """(doc_id, idx, action, reason, score) of every block of the written parts.

    The lowest scores go until ``share`` of what may go is reached; blocks that kept ones hang on by a
    strong edge come back; then blocks that hold terms of the question which nothing kept holds
    any more, ``most_restored`` at most, the greatest scores first.
    """
    b = p.filter("is_block")
    if not question.strip():
        return b.select("doc_id", "idx", F.when(F.col("why") == "standalone_instruction", "drop").otherwise("keep").alias("action"), F.coalesce("why", F.lit("scored")).alias("reason"), "score")
    out = b.filter("why = 'standalone_instruction'").select("doc_id", "idx")
    low = C.budget_drop(b.filter("coalesce(why, '') <> 'standalone_instruction'").select("doc_id", "idx", "n_chars", "score", F.col("why").isNotNull().alias("protected"), "key"), share)
    low = materialize(low, "low")
    kept = b.select("doc_id", "idx").join(low.unionByName(out), ["doc_id", "idx"], "left_anti")
    strong = D.edges(b.select("doc_id", "idx", F.col("block_id").alias("part_id"), "duplicate_of", "text"), question).filter(F.col("type").isin(*STRONG))
    back = D.closure(strong, kept).join(low, ["doc_id", "idx"], "left_semi").select("doc_id", "idx", F.lit("dependency").alias("back"))
    state = b.select("doc_id", "idx", "score", "why", "hits").join(low.withColumn("low", F.lit(True)), ["doc_id", "idx"], "left").join(back, ["doc_id", "idx"], "left")
    gone = F.col("low") & F.col("back").isNull()
    state = materialize(state.withColumn("gone", F.coalesce(gone, F.lit(False)) | (F.coalesce("why", F.lit("")) == "standalone_instruction")), "state")
    # each missing term is brought back by the best block that holds it
    held = state.select("doc_id", "idx", "score", "gone", "why", F.explode("hits").alias("term"))
    lacking = held.groupBy("doc_id", "term").agg(F.bool_and("gone").alias("missing")).filter("missing").select("doc_id", "term")
    best = F.row_number().over(W.partitionBy("doc_id", "term").orderBy(F.desc("score"), "idx"))
    restore = held.filter("coalesce(why, '') <> 'standalone_instruction'").join(lacking, ["doc_id", "term"]).withColumn("r", best).filter("r = 1").select("doc_id", "idx", "score").distinct()
    restore = restore.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "idx"))).filter(F.col("r") <= most_restored).select("doc_id", "idx", F.lit(True).alias("restored"))
    d = state.join(restore, ["doc_id", "idx"], "left")
    reason = F.when(F.col("restored"), "missing_evidence").when(F.col("why").isNotNull(), F.col("why")).when(F.col("gone"), "low_score").otherwise(F.coalesce("back", F.lit("scored")))
    return d.select("doc_id", "idx", F.when(F.col("gone") & F.col("restored").isNull(), "drop").otherwise("keep").alias("action"), reason.alias("reason"), "score")


def sufficiency(p: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, n_terms, n_missing, missing, sufficient): terms of the question that a document held and what is kept does not."""
    kept = p.filter("is_block").join(decisions.filter("action = 'keep'").select("doc_id", "idx", F.lit(True).alias("kept")), ["doc_id", "idx"], "left")
    t = kept.select("doc_id", F.col("kept").isNotNull().alias("kept"), F.explode_outer("hits").alias("term")).groupBy("doc_id", "term").agg(F.bool_or("kept").alias("kept"))
    missing = F.array_sort(F.collect_set(F.when(~F.col("kept") & F.col("term").isNotNull(), F.col("term"))))
    return t.groupBy("doc_id").agg(F.count("term").alias("n_terms"), missing.alias("m")).select("doc_id", "n_terms", F.size("m").alias("n_missing"), F.array_join("m", ",").alias("missing"), (F.size("m") == 0).alias("sufficient"))


def assemble(p: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, text, n_dropped, n_markers): gaps and kept blocks to the character; a run of dropped blocks is one marker with its size.

    The gap before a run stays, those within it go with it.
    """
    d = p.join(decisions.select("doc_id", "idx", "action"), ["doc_id", "idx"], "left").withColumn("gone", F.coalesce(F.col("action") == "drop", F.lit(False)))
    by = W.partitionBy("doc_id").orderBy("idx")
    d = d.withColumn("starts", F.col("gone") & ~F.coalesce(F.lag("gone").over(by), F.lit(False))).withColumn("run", F.sum(F.col("starts").cast("int")).over(by))
    size = W.partitionBy("doc_id", "run", "gone")
    d = d.withColumn("k", F.count("*").over(size)).withColumn("chars", F.sum("n_chars").over(size))
    last_end = F.last(F.when(F.col("text").rlike(r"\r\n\z"), "\r\n").when(F.col("text").rlike(r"\n\z"), "\n").when(F.col("text").rlike(r"\r\z"), "\r").otherwise("")).over(size.orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    marker = F.concat(F.format_string("[%d blocks left out: %d characters]", "k", "chars"), last_end)
    piece = F.when(F.col("starts"), F.concat("gap_before", marker)).when(F.col("gone"), F.lit("")).otherwise(F.concat("gap_before", F.coalesce("text", F.lit(""))))
    return d.withColumn("piece", piece).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"]), "").alias("text"), F.count_if("gone").alias("n_dropped"), F.count_if("starts").alias("n_markers"))


def compact(df: DataFrame, question: str, share: float = 0.3, **protect) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, decisions, texts) of the whole chain; parts and decisions are written once."""
    p = materialize(parts(df, question, **protect), "blocks")
    d = materialize(decide(p, question, share), "decisions")
    return p, d, assemble(p, d)


def explained(decisions: DataFrame) -> DataFrame:
    """(doc_id, idx, action, reason, score, explanation): each decision in words."""
    words = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return decisions.withColumn("explanation", words[F.col("reason")])


def representation(p: DataFrame, decisions: DataFrame, question: str) -> DataFrame:
    """(doc_id, units, selection): a document's blocks as units with their provenance and necessity, and what was done with them."""
    u = p.filter("is_block").join(decisions.select("doc_id", "idx", "action", "reason"), ["doc_id", "idx"])
    unit = F.struct("idx", F.col("block_id").alias("id"), F.sha2("text", 256).alias("digest"), F.col("score").alias("relevance"), F.when(F.col("why").isNotNull(), "protected").when(F.col("reason").isin("dependency", "missing_evidence"), "required").otherwise("optional").alias("necessity"), F.col("duplicate_of"))
    pick = lambda a: F.array_sort(F.collect_list(F.when(F.col("action") == a, F.col("block_id"))))
    return u.groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias("units"), pick("keep").alias("kept"), pick("drop").alias("dropped")).select("doc_id", "units", F.struct("kept", "dropped", F.lit(question).alias("rationale")).alias("selection"))


def ablation(p: DataFrame) -> DataFrame:
    """(doc_id, idx, other, outcome): what may be taken out by itself, and which two may not go together.

    A block is ``essential`` if it alone holds a term of the question, else ``removable``; two
    removable blocks are an ``essential_pair`` if a term stands in just these two. Pairs come
    from terms with two holders, so no pairs are tried that no term joins.
    """
    b = p.filter("is_block")
    t = b.select("doc_id", "idx", F.explode("hits").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b"))
    alone = t.filter("n = 1").select("doc_id", F.col("a").alias("idx")).distinct()
    single = b.select("doc_id", "idx").join(alone.withColumn("alone", F.lit(True)), ["doc_id", "idx"], "left").select("doc_id", "idx", F.lit(None).cast("int").alias("other"), F.when(F.col("alone"), "essential").otherwise("removable").alias("outcome"))
    pairs = t.filter("n = 2").select("doc_id", F.col("a").alias("idx"), F.col("b").alias("other")).distinct()
    pairs = pairs.join(alone, ["doc_id", "idx"], "left_anti").join(alone.select("doc_id", F.col("idx").alias("other")), ["doc_id", "other"], "left_anti")
    return single.unionByName(pairs.select("doc_id", "idx", "other", F.lit("essential_pair").alias("outcome")))


def sticky(decisions: DataFrame, p: DataFrame, cache: DataFrame, identity: str) -> DataFrame:
    """The decisions with those of an earlier pass in their place, where one was made of the same block under the same identity.

    cache: (identity, key, action, reason); identity names everything else that a decision depends on.
    """
    keyed = decisions.join(p.filter("is_block").select("doc_id", "idx", "key"), ["doc_id", "idx"])
    known = cache.filter(F.col("identity") == identity).groupBy("key").agg(F.min(F.struct("action", "reason")).alias("was"))
    j = keyed.join(known, "key", "left")
    return j.select("doc_id", "idx", F.coalesce("was.action", "action").alias("action"), F.coalesce("was.reason", "reason").alias("reason"), "score", F.col("was").isNotNull().alias("reused"))


def observed(p: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, idx, action): blocks by a judge's answers (doc_id, idx, label); fail-closed.

    NO_MATCH blocks are dropped, MATCH blocks kept. A document with an answer that is missing,
    double, unknown or about no block keeps all of its blocks.
    """
    b = p.filter("is_block").select("doc_id", "idx")
    a = answers.groupBy("doc_id", "idx").agg(F.count("*").alias("n"), F.max("label").alias("label"))
    j = b.withColumn("mine", F.lit(True)).join(a, ["doc_id", "idx"], "full_outer")
    bad = F.col("mine").isNull() | F.col("n").isNull() | (F.col("n") != 1) | ~F.coalesce(F.col("label").isin("MATCH", "NO_MATCH"), F.lit(False))
    j = j.withColumn("failed", F.bool_or(bad).over(W.partitionBy("doc_id")))
    return j.filter("mine").select("doc_id", "idx", F.when(~F.col("failed") & (F.col("label") == "NO_MATCH"), "drop").otherwise("keep").alias("action"))


def rule_floor(p: DataFrame, k_goal: int = 3, k_error: int = 2) -> DataFrame:
    """(doc_id, idx, rule): the blocks that best meet the question, ties to the later, and the last that show an error."""
    b = p.filter("is_block")
    goal = b.filter("score > 0").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("idx")))).filter(F.col("r") <= k_goal)
    error = b.filter(F.col("text").rlike(fixed.ERROR)).withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("idx")))).filter(F.col("r") <= k_error)
    return goal.select("doc_id", "idx", F.lit("goal").alias("rule")).unionByName(error.select("doc_id", "idx", F.lit("error").alias("rule")))


# --- cases and suites --------------------------------------------------------------------------


def case_results(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, saved_percent, recall, n_forbidden, passed, failed_gates) of cases against outputs (id, text, tokens_before, tokens_after).

    cases: (id, required, forbidden, min_saved, max_saved, min_recall); null gates are not asked for.
    """
    j = cases.join(outputs, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    has = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda m: F.contains(F.col("text"), m)))
    n = F.size(F.coalesce("required", F.array().cast("array<string>")))
    j = j.withColumn("saved_percent", F.when(F.col("tokens_before") > 0, F.round((F.col("tokens_before") - F.col("tokens_after")) * 100 / F.col("tokens_before"), 2)).otherwise(0.0))
    j = j.withColumn("recall", F.when(n == 0, 1.0).otherwise(F.round(has("required") / n, 4))).withColumn("n_forbidden", has("forbidden"))
    gates = F.array(F.when(F.col("saved_percent") < F.col("min_saved"), "min_saved"), F.when(F.col("saved_percent") > F.col("max_saved"), "max_saved"), F.when(F.col("recall") < F.col("min_recall"), "min_recall"), F.when(F.col("n_forbidden") > 0, "forbidden"))
    j = j.withColumn("failed", F.filter(gates, lambda g: g.isNotNull()))
    return j.select("id", "saved_percent", "recall", "n_forbidden", (F.size("failed") == 0).alias("passed"), F.array_join("failed", ",").alias("failed_gates"))


def suite(results: DataFrame) -> DataFrame:
    """One row: cases, passed, failed, mean savings and mean recall."""
    return results.agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.round(F.avg("saved_percent"), 2).alias("mean_saved"), F.round(F.avg("recall"), 4).alias("mean_recall"))


# --- transcripts as text -------------------------------------------------------------------------


def rendered(messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, part, message_index, role, kind, tool, header, char_start, char_end): a session as text with a header line for each part.

    Parts of a message are its text, its calls and its results; a blank line stands between
    parts. Only lengths go into the running sum, so a session's texts need not stand in one place.
    """
    known = F.col("session_id").isNotNull() & F.col("message_index").isNotNull()
    m = messages.filter(known).groupBy("session_id", "message_index").agg(F.max(F.struct(F.lower(F.trim("role")).alias("role"), F.length("text").alias("n"))).alias("m"))
    role = F.when(F.coalesce("m.role", F.lit("")) == "tool", "user").otherwise(F.coalesce("m.role", F.lit("")))
    m = m.select("session_id", "message_index", role.alias("role"), F.coalesce("m.n", F.lit(0)).alias("n"))
    t = m.filter("n > 0").select("session_id", "message_index", F.lit(0).alias("k"), F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tool"), "n")
    c = calls.filter(known).groupBy("session_id", "message_index", "pos", "call_id").agg(F.min("tool").alias("tool"), F.max(F.length(F.coalesce("input_json", F.lit("{}")))).alias("n"))
    names = c.groupBy("session_id", "call_id").agg(F.min("tool").alias("tool"))
    r = results.filter(known).groupBy("session_id", "message_index", "pos", "result_id", "call_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n")).join(names, ["session_id", "call_id"], "left")
    every = t.unionByName(c.select("session_id", "message_index", F.lit(1).alias("k"), "pos", F.lit("tool_use").alias("kind"), "tool", "n")).unionByName(r.select("session_id", "message_index", F.lit(2).alias("k"), "pos", F.lit("tool_result").alias("kind"), "tool", "n"))
    every = every.join(m.select("session_id", "message_index", "role"), ["session_id", "message_index"], "left").withColumn("role", F.coalesce("role", F.lit("user")))
    header = F.concat(F.format_string("[m%04d %s %s", "message_index", "role", "kind"), F.coalesce(F.concat(F.lit(" "), F.col("tool")), F.lit("")), F.lit("]"))
    every = every.withColumn("header", header).withColumn("size", F.length("header") + 1 + F.col("n"))
    w = W.partitionBy("session_id").orderBy("message_index", "k", "pos", "header", "n")
    start = F.coalesce(F.sum(F.col("size") + 2).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return every.select("session_id", F.row_number().over(w).alias("part"), "message_index", "role", "kind", "tool", "header", start.alias("char_start"), (start + F.col("size")).alias("char_end"))


def calls_by_blocks(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_id, call_id, action, score): a call goes only where every block that overlaps its segments goes; the score is the greatest.

    segments: (session_id, call_id, char_start, char_end); blocks: (session_id, char_start, char_end, action, score).
    Both are laid out over stretches of 4,096 characters, so that they meet by equality.
    """
    stretch = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("char_start") / 4096), F.floor((F.greatest("char_end", F.col("char_start") + 1) - 1) / 4096))))
    a, b = stretch(segments).alias("a"), stretch(blocks.withColumnsRenamed({"char_start": "b_start", "char_end": "b_end"}).select("*", F.col("b_start").alias("char_start"), F.col("b_end").alias("char_end")).select("*")).drop("char_start", "char_end")
    j = a.join(b, ["session_id", "cell"]).filter((F.col("char_start") < F.col("b_end")) & (F.col("b_start") < F.col("char_end")))
    return j.groupBy("session_id", "call_id").agg(F.when(F.bool_and(F.col("action") == "drop"), "drop").otherwise("keep").alias("action"), F.max("score").alias("score"))
