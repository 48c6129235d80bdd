"""What calls and texts refer to, what changes after them, and how far two versions agree."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import fixed, jsontext, text as X

# The endings by which a bare name is a file's.
FILE_NAME = r"\b[\w-]+\.(?:py|ts|tsx|js|jsx|md|json|toml|yaml|yml|sql|css|html|sh|go|rs)\b"
SLASHED = r"[\w.~-]*/[\w.-]+(?:/[\w.-]+)*"
# Words a cut must not come before, for they turn what stands before them.
TURN = re.compile(r"(?i)\b(?:except|exception|excluding|unless|only|not|no|never|but|however|although|though|otherwise|without|despite|until|before|after|if|as long as|subject to|provided that)\b")


def refs(text: Column) -> Column:
    """Distinct addresses, slashed paths and file names in a text, first seen first by kind."""
    every = F.concat(F.regexp_extract_all(text, F.lit(r"https?://\S+"), 0), F.regexp_extract_all(text, F.lit(SLASHED), 0), F.regexp_extract_all(text, F.lit(FILE_NAME), 0))
    return F.array_distinct(F.filter(every, lambda r: F.length(r) >= 4))


def named_calls(stream: DataFrame, texts: DataFrame) -> DataFrame:
    """(session_id, ref, call_id, seq): the last call on each file that a session's texts name.

    A path is named by itself or by its ending after a slash; both are keys of one equi-join:
    every ending of a path is laid out, so no path is compared with all names.
    """
    r = texts.filter(F.col("session_id").isNotNull()).select("session_id", F.explode(refs(F.col("text"))).alias("ref")).distinct()
    parts = F.split("path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    c = stream.filter("path is not null and path <> ''").select("session_id", "call_id", "seq", F.explode(F.array_distinct(endings)).alias("ref"))
    return c.join(r, ["session_id", "ref"], "left_semi").groupBy("session_id", "ref").agg(F.max_by("call_id", "seq").alias("call_id"), F.max("seq").alias("seq"))


def later_writes(stream: DataFrame) -> DataFrame:
    """(session_id, call_id, writes_same, writes_near): edits after a read of a file, of the file and in its folder."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    edit = F.col("tool").isin(*fixed.EDIT_TOOLS).cast("int")
    after = lambda *by: W.partitionBy("session_id", *by).orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    s = stream.filter("path is not null").withColumn("folder", folder)
    s = s.withColumn("writes_same", F.coalesce(F.sum(edit).over(after("path")), F.lit(0))).withColumn("writes_near", F.coalesce(F.sum(edit).over(after("folder")), F.lit(0)))
    return s.filter("tool = 'read'").select("session_id", "call_id", "seq", "writes_same", "writes_near")


def path_references(stream: DataFrame) -> DataFrame:
    """(path, n_calls, n_sessions, n_edits)"""
    return stream.filter("path is not null").groupBy("path").agg(F.count("*").alias("n_calls"), F.count_distinct("session_id").alias("n_sessions"), F.count_if(F.col("tool").isin(*fixed.EDIT_TOOLS)).alias("n_edits"))


def stable_prefix(pairs: DataFrame, a: str, b: str) -> Column:
    """The number of leading lines that two texts have in common."""
    x, y = F.split(pairs[a], "\n"), F.split(pairs[b], "\n")
    n = F.least(F.size(x), F.size(y))
    same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q)
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise((first - 1).cast("int"))


def version_changes(superseded: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, call_id, superseded_by, n_lines, stable_lines): how much of an output its successor keeps at its head."""
    t = results.select("session_id", "call_id", F.coalesce("text", F.lit("")).alias("text"))
    p = superseded.filter("superseded_by is not null").select("session_id", "call_id", "superseded_by")
    p = p.join(t.withColumnRenamed("text", "old"), ["session_id", "call_id"]).join(t.select("session_id", F.col("call_id").alias("superseded_by"), F.col("text").alias("new")), ["session_id", "superseded_by"])
    return p.select("session_id", "call_id", "superseded_by", F.size(F.split("old", "\n")).alias("n_lines"), stable_prefix(p, "old", "new").alias("stable_lines"))


def stash_decisions(decisions: DataFrame, pointers: DataFrame, repeated: DataFrame, note: int = 60) -> DataFrame:
    """(session_id, call_id, action, reason) where outputs that rules remove are stashed, and nothing is dropped.

    A call of a repeated id stays; a pointer to the same output later wins over the stash; an
    output is stashed where a rule drops or trims it and it is longer than its note.
    """
    d = decisions.select("session_id", "call_id", "action", "reason", "n_chars")
    d = d.join(pointers.select("session_id", "call_id", "points_to"), ["session_id", "call_id"], "left").join(repeated.select("session_id", "call_id", F.lit(True).alias("repeated")), ["session_id", "call_id"], "left")
    what = (
        F.when(F.col("repeated"), F.struct(F.lit("keep").alias("a"), F.lit("repeated_id").alias("r")))
        .when(F.col("points_to").isNotNull() & (F.col("reason") != "pinned"), F.struct(F.lit("point").alias("a"), F.col("points_to").alias("r")))
        .when(F.col("action").isin("drop", "trim") & (F.col("n_chars") > note), F.struct(F.lit("stash").alias("a"), F.col("reason").alias("r")))
        .otherwise(F.struct(F.lit("keep").alias("a"), F.lit("not_eligible").alias("r")))
    )
    return d.withColumn("w", what).select("session_id", "call_id", F.col("w.a").alias("action"), F.col("w.r").alias("reason"))


def line_reasons(lines: DataFrame, text: str = "line") -> DataFrame:
    """(reason, n): whether lines can be read: ok, blank, not_json, not_object or no_type."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    reason = (
        F.when(F.col(text).isNull() | (F.trim(text) == ""), "blank").when(v.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_object")
        .when(F.try_variant_get(v, "$.type", "string").isNull(), "no_type").otherwise("ok")
    )
    return lines.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Lower case without accents (compatibility forms taken apart, marks left out)."""
    one = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return s.map(one, na_action="ignore")


def folded_frequency(df: DataFrame) -> DataFrame:
    """(term, n_docs) with accents folded, so *réparé* and *repare* are one term."""
    t = df.filter("text is not null").select(F.explode(X.terms(fold(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n_docs"))


#: A text is cut only where it exceeds the budget by more than this; the turn of meaning is looked for so far before a cut.
SLACK, LOOK_BACK = 200, 120


def _heads(text: str, budget: int, kind: str) -> list[str]:
    """What may stand for a text of that kind, the best first."""
    ends = [m.start() for m in re.finditer("\n", text)]
    if kind == "markdown_table":
        fits = [e for e in ends if e < budget]
        return [text[: fits[-1]]] if len(fits) >= 3 else []
    if kind == "logs":
        quarter = ends[len(ends) // 4] if ends else 0
        head = [e for e in ends if 0 < e <= min(budget // 3, quarter)]
        tail = [e for e in ends if e >= len(text) - 2 * budget // 3]
        return [text[: head[-1]] + text[tail[0] :]] if head and tail else []
    if kind == "json":
        return [text[:e] for e in ends if e <= budget][::-1]
    stops = ends if kind in ("code", "config", "markdown") else [m.start() for m in re.finditer(" ", text)]
    late = [e for e in stops if max(20, budget // 2) <= e < budget]
    return [text[: late[-1]] if late else text[:budget]]


def _is_json(text: str) -> bool:
    try:
        jsontext.loads(text)
    except ValueError:
        return False
    return True


def _fields(text: str) -> set[str]:
    """Names that stand before a colon or an equals sign."""
    return set(re.findall(r"(?m)^\s*[\"']?([A-Za-z_][\w.-]*)[\"']?\s*[:=]", text))


def trimmed(text: str, budget: int, kind: str) -> str | None:
    """The head of a text that says no less than it seems to, or None where there is none.

    A table keeps its head, delimiter and whole rows, a log its two ends, JSON what parses by
    itself; code, settings and Markdown end at a line, prose at a word. XML, YAML and texts of
    high risk are never cut. Refused where what is left out turns the meaning of what
    stays, or names a field that no longer stands anywhere.
    """
    if len(text) <= budget + SLACK or kind in ("xml", "yaml", "high_risk"):
        return None
    for head in _heads(text, budget, kind):
        gone = text[len(head) :]
        if not head.strip() or kind == "json" and not _is_json(head):
            continue
        if kind not in ("logs", "markdown_table") and (TURN.search(gone) or kind != "json" and TURN.search(head[-LOOK_BACK:])):
            continue
        if kind in ("config", "json") and _fields(gone) - _fields(head):
            continue
        return head
    return None


def safe_trims(df: DataFrame, budget: int = 400) -> DataFrame:
    """(doc_id, content_type, n_chars, trimmed): texts with the head that may stand for them, null where none may."""

    @F.pandas_udf(T.StringType())
    def head(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else trimmed(a, budget, b) for a, b in zip(t, k)], dtype=object)

    rows = df.filter("text is not null").select("doc_id", "text", X.content_type(F.col("text")).alias("content_type"))
    return rows.select("doc_id", "content_type", F.length("text").alias("n_chars"), head("text", "content_type").alias("trimmed"))
