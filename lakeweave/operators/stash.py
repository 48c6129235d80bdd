"""Outputs kept elsewhere under their hash: put, list, search, recall with proof, verify, collect; and reports on passes.

A blob is (sha256, text). All look-ups are joins on the hash or its first twelve digits; scoring
goes through an inverted index of terms, so no prompt is compared with an output that
shares no term with it.

Defined results: null texts are no blobs; equal texts are one blob; an id that begins several
hashes is ambiguous; a report without usable numbers is told with its reason, never dropped.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.functions import fixed, text as X

# Marks of a command's end and of failures, by which a note names an output.
EXIT = r"^(?:Process exited with code|Exit code:?|exit code:?)\s*(-?\d+)\b"
FAILED_TEST = r"(?m)^(?:FAILED|ERROR) (\S+::\S+)"
ERROR_TYPE = r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\b"
RUN_HEADER = r"^(?:Chunk ID|Wall time|Process exited with code|Process running with session ID|Original token count)\b"
# Report formats and the labels that may be told; any other is "other".
BLOCK_REPORT, TRANSCRIPT_REPORT = "relevance-compaction-1.", "transcript-compaction-1."
MODES = ("blocks", "tool-calls")
PROVIDERS = ("mechanical", "rules", "auto", "cache", "degraded")
LARGEST_NUMBER = 1e12
# Hints.
LEAST_SCORE, GAP, MOST_HINTS = 3.0, 1.5, 2
UNITS = {"": 86400, "d": 86400, "h": 3600, "m": 60}
LEAST_AGE = 3600


def label(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value where it may be told, else ``other``."""
    return F.when(value.isin(*allowed), value).otherwise("other")


def parse_age(text: str) -> int:
    """Seconds of ``30d``, ``12h``, ``90m`` or bare days; an hour at least."""
    m = re.fullmatch(r"(\d+)([dhm]?)", text.strip())
    if not m:
        raise ValueError(f"an age looks like 30d, 12h or 90m, not {text!r}")
    seconds = int(m[1]) * UNITS[m[2]]
    if seconds < LEAST_AGE:
        raise ValueError("an age must be an hour at least")
    return seconds


def parse_since(text: str | None) -> datetime.date | None:
    """The day of ``YYYY-MM-DD``."""
    if text is None:
        return None
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"a day looks like YYYY-MM-DD, not {text!r}")
    return datetime.date.fromisoformat(text)


# --- reports and request logs ------------------------------------------------------------------


def passes(reports: DataFrame) -> DataFrame:
    """(report_id, reason, mode, provider, tokens_before, tokens_after, ratio): what each report says, or why it is skipped.

    Token counts are rounded half up to hundreds, the ratio to hundredths. A ratio that is
    missing or no number comes from the counts.
    """
    number = lambda c: F.when(F.col(c).between(0, LARGEST_NUMBER) & ~F.isnan(c), F.col(c))
    r = reports.dropDuplicates(["report_id"])
    schema = F.coalesce("schema_version", F.lit(""))
    known = schema.startswith(BLOCK_REPORT) | schema.startswith(TRANSCRIPT_REPORT)
    r = r.withColumn("b", number("tokens_before")).withColumn("a", number("tokens_after"))
    from_counts = F.when(F.col("b") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("a") / F.col("b")))
    r = r.withColumn("ratio", F.coalesce(number("reduction_ratio"), from_counts))
    reason = F.when(~known, "unsupported_format").when(F.col("b").isNull() | F.col("a").isNull() | (F.col("ratio") > 1), "invalid_fields").otherwise("ok")
    r = r.withColumn("reason", reason)
    ok = lambda c: F.when(F.col("reason") == "ok", c)
    mode = F.when(schema.startswith(BLOCK_REPORT), "blocks").otherwise(label(F.coalesce("mode", F.lit("tool-calls")), MODES))
    rounded = lambda c: X.round_half_up(F.floor(c), 100).cast("bigint")
    return r.select("report_id", "reason", ok(mode).alias("mode"), ok(label(F.coalesce("provider_used", F.lit("")), PROVIDERS)).alias("provider"), ok(rounded("b")).alias("tokens_before"), ok(rounded("a")).alias("tokens_after"), ok(F.floor(F.col("ratio") * 100 + 0.5) / 100).alias("ratio"))


def request_log(lines: DataFrame, since: str | None = None, text: str = "line", day: str = "$.timestamp") -> DataFrame:
    """(outcome, n) of log lines: kept, too_old (or without a day, where one is asked for), skipped; blank lines are no lines."""
    v = F.try_parse_json(text)
    at = F.substring(F.try_variant_get(v, day, "string"), 1, 10)
    outcome = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "skipped")
    if parse_since(since):
        outcome = outcome.when(~F.coalesce(at.rlike(r"^\d{4}-\d{2}-\d{2}$") & (at >= since), F.lit(False)), "too_old")
    rows = lines.filter(F.coalesce(F.trim(text), F.lit("")) != "")
    return rows.select(outcome.otherwise("kept").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def append_ledger(rows: DataFrame, path: str) -> None:
    """One counts-only JSON line a row, behind those that are there: text columns are left out."""
    counts = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "boolean", "date")]
    rows.select(F.to_json(F.struct(*counts)).alias("value")).write.mode("append").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """The rows as JSON lines, nested columns included."""
    df.write.mode("errorifexists").json(path)


# --- the stash ---------------------------------------------------------------------------------


def put(texts: DataFrame, path: str, text: str = "text") -> int:
    """Add the texts that the stash at ``path`` lacks, each once; how many there are now."""
    spark = texts.sparkSession
    new = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("sha256"), F.col(text).alias("text")).dropDuplicates(["sha256"])
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first put makes the folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(old.select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def proven(stash: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, outcome, sha256) for ids of 12 to 64 hex digits: ok, missing, ambiguous, hash_mismatch or invalid.

    stash: (sha256, text). A blob is ok only where its text still has the hash it is kept under.
    """
    ids = wanted.select("id").distinct().withColumn("valid", F.coalesce(F.col("id").rlike(r"^[0-9a-f]{12,64}$"), F.lit(False)))
    blobs = stash.select(F.substring("sha256", 1, 12).alias("id12"), "sha256", (F.sha2("text", 256) == F.col("sha256")).alias("whole"))
    met = ids.withColumn("id12", F.when(F.col("valid"), F.substring("id", 1, 12))).join(blobs, "id12", "left")
    met = met.withColumn("hit", F.coalesce(F.col("sha256").startswith(F.col("id")), F.lit(False)))
    per = met.groupBy("id", "valid").agg(F.count_if("hit").alias("n"), F.max(F.when(F.col("hit"), F.col("sha256"))).alias("sha256"), F.bool_and(F.when(F.col("hit"), F.coalesce("whole", F.lit(False)))).alias("whole"))
    outcome = F.when(~F.col("valid"), "invalid").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(~F.col("whole"), "hash_mismatch").otherwise("ok")
    return per.select("id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("sha256")).alias("sha256"))


def listing(results: DataFrame, texts: DataFrame) -> DataFrame:
    """(id12, n_bytes, n_lines, n_sessions, created_at, n_refs): a row for each blob; refs are the texts that name it."""
    r = results.filter(F.col("text").isNotNull())
    lines = F.size(F.split(F.regexp_replace("text", r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))
    b = r.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.max(F.octet_length("text")).alias("n_bytes"), F.max(F.when(F.col("text") == "", 0).otherwise(lines)).alias("n_lines"), F.count_distinct("session_id").alias("n_sessions"), F.min("returned_at").alias("created_at"))
    named = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([0-9a-f]{12})\b"), 1))).alias("id12")).groupBy("id12").agg(F.count("*").alias("refs"))
    return b.withColumn("id12", F.substring("sha256", 1, 12)).join(named, "id12", "left").select("id12", "n_bytes", "n_lines", "n_sessions", "created_at", F.coalesce("refs", F.lit(0)).alias("n_refs"))


def collectable(blobs: DataFrame, now: Column, older_than: str = "30d") -> DataFrame:
    """Of a listing, the blobs that nothing names and that are as old as that."""
    age = now.cast("double") - F.col("created_at").cast("double")
    return blobs.filter((F.col("n_refs") == 0) & (age >= parse_age(older_than)))


def hint_terms(text: Column) -> Column:
    """(key, weight) of the terms of a text; a path is taken apart too.

    3 for identifiers, paths and numbers of three characters or more, 2 for a capital that
    does not begin the text and from eight letters on, 1 for other words, 0 below four letters
    and for stop words. A term keeps its greatest weight.
    """
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\w[\w./:-]*"), 0), lambda w: F.regexp_replace(w, r"[./:-]+$", "")), lambda w: w != "")
    parts = lambda w: F.filter(F.transform(F.split(w, "[/:]+"), lambda p: F.regexp_replace(p, r"^[.-]+|[.-]+$", "")), lambda p: (p != "") & (p != w))
    every = F.flatten(F.transform(found, lambda w: F.when(w.rlike("[/:]"), F.concat(F.array(w), parts(w))).otherwise(F.array(w))))
    strong = lambda w: w.rlike(r"[0-9_./:-]|[a-z][A-Z]")
    weight = lambda w, i: (
        F.when(strong(w), F.when(F.length(w) >= 3, 3).otherwise(0)).when((F.length(w) < 4) | F.lower(w).isin(*fixed.STOPWORDS), 0).when((w.rlike("^[A-Z]") & (i > 0)) | (F.length(w) >= 8), 2).otherwise(1)
    )
    return F.transform(every, lambda w, i: F.struct(F.lower(w).alias("key"), weight(w, i).alias("weight")))


def index(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key) of every term an output holds: the stash's inverted index."""
    t = F.array_distinct(F.transform(hint_terms(F.col("text")), lambda x: x["key"]))
    return results.filter(F.col("text").isNotNull()).groupBy(*keys).agg(F.max("text").alias("text")).select(*keys, F.explode(t).alias("key"))


def search(results: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(result_id, score, terms, rank): the outputs that hold terms of the query, best first; ``limit`` is the number asked for."""
    spark = results.sparkSession
    q = spark.range(1).select(F.explode(hint_terms(F.lit(query))).alias("t")).groupBy("t.key").agg(F.max("t.weight").alias("weight")).filter("weight > 0")
    held = index(results, ["result_id"]).join(F.broadcast(q), "key")  # a row for each term of the query
    df = held.groupBy("key").agg(F.count("*").alias("df"))
    s = held.join(df, "key").groupBy("result_id").agg(F.round(F.sum(F.col("weight") / F.col("df")), 9).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "key"))), lambda x: x["key"]), ",").alias("terms"))
    top = s.orderBy(F.desc("score"), "result_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "result_id")))


def hints(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """(session_id, message_index, result_id, score, rank): for each prompt the outputs of its session that it clearly names.

    A term's weight is shared by the outputs that hold it. Of the ranking the longest head of two or
    one is shown in which every score is 3 or more with a term of weight 2 or more, and the last
    shown has one and a half times the score of the first left out.
    """
    at = ["session_id", "message_index"]
    p = prompts.filter(F.col("session_id").isNotNull()).select(*at, F.explode(hint_terms(F.col("text"))).alias("t")).groupBy(*at, "t.key").agg(F.max("t.weight").alias("weight")).filter("weight > 0")
    held = index(results.filter(F.col("session_id").isNotNull()), ["session_id", "result_id"])
    df = held.groupBy("session_id", "key").agg(F.count("*").alias("df"))
    s = p.join(df, ["session_id", "key"]).join(held, ["session_id", "key"]).groupBy(*at, "result_id").agg(F.round(F.sum(F.col("weight") / F.col("df")), 9).alias("score"), F.max("weight").alias("top"))
    w = W.partitionBy(*at).orderBy(F.desc("score"), "result_id")
    s = s.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("fits", (F.col("score") >= LEAST_SCORE) & (F.col("top") >= 2))
    shown = s.groupBy(*at).agg(*[F.bool_and(F.when(F.col("rank") <= k, F.col("fits"))).alias(f"fit{k}") for k in (1, 2)], *[F.max(F.when(F.col("rank") == k, F.col("score") >= GAP * F.col("next"))).alias(f"gap{k}") for k in (1, 2)])
    n = F.when(F.col("fit2") & F.col("gap2"), 2).when(F.col("fit1") & F.col("gap1"), 1).otherwise(0)
    return s.join(shown.select(*at, n.alias("n")), at).filter("rank <= n").select(*at, "result_id", "score", "rank")


def lean_fields(text: Column) -> tuple[Column, Column, Column]:
    """(exit code, up to two failed tests or error types, first line) of an output."""
    ls = F.split(text, "\r\n|\r|\n")
    near = F.concat(F.slice(ls, 1, 4), F.reverse(F.slice(F.reverse(ls), 1, 3)))
    codes = F.filter(F.transform(near, lambda x: F.regexp_extract(F.trim(x), EXIT, 1)), lambda x: x != "")
    ids = F.array_distinct(F.transform(F.concat(F.regexp_extract_all(text, F.lit(FAILED_TEST), 1), F.regexp_extract_all(text, F.lit(ERROR_TYPE), 1)), lambda x: F.substring(x, 1, 60)))
    body = F.filter(F.transform(ls, lambda x: F.trim(x)), lambda x: ~x.rlike(RUN_HEADER) & (x != "Output:") & (x != ""))
    first = F.coalesce(F.get(body, F.lit(0)), F.lit(""))
    cut = F.when(F.length(first) > 60, F.concat(F.substring(first, 1, 60), F.lit("…"))).otherwise(first)
    return F.get(codes, F.lit(0)), F.array_join(F.slice(ids, 1, 2), ", "), cut


def lean_notes(results: DataFrame) -> DataFrame:
    """(result_id, exit_code, named, opening): what a short note says of an output."""
    code, named, opening = lean_fields(F.col("text"))
    return results.filter(F.col("result_id").isNotNull() & F.col("text").isNotNull()).groupBy("result_id").agg(F.max("text").alias("text")).select("result_id", code.alias("exit_code"), named.alias("named"), opening.alias("opening"))


def disk_states(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, state, compared_as, lines_compared, lines_differ): whether files (path, content) still hold what outputs (id, path, text) showed.

    An output whose lines are all numbered, in order, is compared line by line at its
    numbers; any other must stand in the file as whole lines in a row. Line ends count.
    """
    split = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n"))
    j = outputs.join(files.select("path", "content"), "path", "left").withColumn("shown", split(F.col("text"))).withColumn("disk", split(F.col("content")))
    row = r"^\s*([1-9][0-9]*)(?:\t|→)(.*)$"
    j = j.withColumn("rows", F.transform("shown", lambda x: F.struct(F.regexp_extract(x, row, 1).try_cast("int").alias("n"), F.regexp_extract(x, r"(?s)" + row, 2).alias("line"))))
    in_order = F.forall(F.transform("rows", lambda r, i: r["n"] - i), lambda d: F.coalesce(d == F.col("rows")[0]["n"], F.lit(False)))
    numbered = (F.size("rows") > 0) & in_order
    differ = F.size(F.filter("rows", lambda r: ~F.coalesce(F.get("disk", r["n"] - 1) == r["line"], F.lit(False))))
    framed = lambda c: F.concat(F.lit("\n"), F.array_join(c, "\n"), F.lit("\n"))
    whole = F.when(F.size("shown") == 0, F.size("disk") == 0).otherwise(F.contains(framed("disk"), framed("shown")))
    j = j.withColumn("numbered", numbered).withColumn("differ", F.when(F.col("numbered"), differ))
    there = F.col("content").isNotNull()
    state = F.when(~there, "missing").when(F.when(F.col("numbered"), F.col("differ") == 0).otherwise(whole), "unchanged").otherwise("changed")
    return j.select("id", state.alias("state"), F.when(there, F.when(F.col("numbered"), "numbered").otherwise("lines")).alias("compared_as"), F.when(there, F.size("shown")).alias("lines_compared"), F.when(there, F.col("differ")).alias("lines_differ"))


def changed_since(emitted: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """(key, state) of what was emitted under a hash against what is there now, re-hashed: same, changed or gone."""
    e, n = emitted.select(key, F.sha2("text", 256).alias("then")).distinct(), now.select(key, F.sha2("content", 256).alias("now"))
    j = e.join(n, key, "left")
    return j.select(key, "then", F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("then"), "same").otherwise("changed").alias("state"))
