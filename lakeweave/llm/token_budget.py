"""Token budgets: how much text each slice of a corpus provides.

Tokens are counted where the text is read (see :mod:`tokens`); only ids and numbers are
shuffled after that. Repeated rows count once, by id. Slices with unknown parts are kept
under ``unknown`` (``und`` for languages), so the totals add up to the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.tokens import with_tokens


def primary_language(lang: Column) -> Column:
    """``en`` for EN, en-GB, en_US; ``und`` for null, blank and undetermined."""
    head = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(head.isNull() | head.isin("", "und", "unk", "mis", "mul", "zxx"), "und").otherwise(head)


def tool_name(tool: Column) -> Column:
    """One spelling of a tool: without server prefix, outer blanks and case."""
    name = F.lower(F.regexp_replace(F.trim(tool), r"^mcp__.*?__", ""))
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(name)


def source_name(source: Column) -> Column:
    name = F.lower(F.trim(source))
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(name)


def _totals(df: DataFrame, corpus: str, part: str) -> DataFrame:
    return df.groupBy(F.lit(corpus).alias("corpus"), F.col(part).alias("part"), "lang", "domain").agg(
        F.count("*").alias("n_records"), F.sum("n_chars").alias("n_chars"), F.sum("tokens").alias("tokens"), F.sum("viterbi_tokens").alias("viterbi_tokens")
    )


def result_tokens(results: DataFrame, model: str | None = None, paths: bool = True) -> DataFrame:
    """(result_id, session_id, project_id, call_id, tokens, viterbi_tokens, n_chars), one row per result."""
    rows = with_tokens(results.select("result_id", "session_id", "project_id", "call_id", "text"), model=model, paths=paths)
    once = F.max(F.struct("tokens", "viterbi_tokens", "n_chars", "session_id", "project_id", "call_id")).alias("r")
    return rows.filter(F.col("result_id").isNotNull()).groupBy("result_id").agg(once).select("result_id", "r.*")


def budget(results: DataFrame, calls: DataFrame, sessions: DataFrame, projects: DataFrame, documents: DataFrame, sources: DataFrame, model: str | None = None) -> DataFrame:
    """(corpus, part, lang, domain, n_records, n_chars, tokens, viterbi_tokens): part is a tool or a source."""
    per = result_tokens(results, model)
    # the first call of an id names the tool; an id is unique in its session at most
    tools = calls.filter(F.col("call_id").isNotNull() & F.col("session_id").isNotNull()).groupBy("session_id", "call_id").agg(F.min_by("tool", F.struct("message_index", "pos", "tool")).alias("tool"))
    known = sessions.groupBy("session_id").agg(F.max("lang").alias("lang"), F.max("project_id").alias("session_project"))
    domains = projects.groupBy(F.col("project_id").alias("domain_project")).agg(F.max("domain").alias("domain"))
    rows = per.join(tools, ["session_id", "call_id"], "left").join(known, "session_id", "left")
    rows = rows.join(domains, F.coalesce("project_id", "session_project") == F.col("domain_project"), "left")
    rows = rows.select(tool_name(F.col("tool")).alias("part"), primary_language(F.col("lang")).alias("lang"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "tokens", "viterbi_tokens", "n_chars")
    docs = with_tokens(documents.select("doc_id", "lang", "source", "text"), model=model).dropDuplicates(["doc_id"])
    docs = docs.withColumn("part", source_name(F.col("source"))).withColumn("lang", primary_language(F.col("lang")))
    of = sources.groupBy(source_name(F.col("source")).alias("part")).agg(F.max("domain").alias("domain"))
    docs = docs.join(of, "part", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    return _totals(rows, "results", "part").unionByName(_totals(docs, "documents", "part"))


def session_totals(results: DataFrame, messages: DataFrame, reports: DataFrame, model: str | None = None) -> DataFrame:
    """(session_id, report_id, result_tokens, message_tokens, tokens, tokens_before, ratio), one row per session and report.

    A session without report has one row with null tokens_before; a report of a session
    without texts is kept with 0 tokens. ratio is null where tokens_before is null or 0.
    """
    res = result_tokens(results, model, paths=False).groupBy("session_id").agg(F.sum("tokens").alias("result_tokens"))
    msg = with_tokens(messages.select("session_id", "message_index", "text"), model=model, paths=False)
    msg = msg.groupBy("session_id", "message_index").agg(F.max("tokens").alias("tokens")).groupBy("session_id").agg(F.sum("tokens").alias("message_tokens"))
    total = res.join(msg, "session_id", "full_outer")
    rep = reports.dropDuplicates(["report_id"]).select("session_id", "report_id", "tokens_before")
    out = total.join(rep, "session_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select("session_id", "report_id", zero("result_tokens").alias("result_tokens"), zero("message_tokens").alias("message_tokens"), (zero("result_tokens") + zero("message_tokens")).alias("tokens"), "tokens_before")
    return out.withColumn("ratio", F.when(F.col("tokens_before") > 0, F.round(F.col("tokens") / F.col("tokens_before"), 4)))
