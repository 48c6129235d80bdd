"""Column builders over text: all of them run in the JVM, inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeweave.functions import fixed


def stripped(text: Column) -> Column:
    """Without white space at either end, any Unicode white space."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def token_estimate(text: Column) -> Column:
    """Estimated tokens: the mean of characters / 4 and words / 0.75, half to even; 0 for blank or null."""
    words = F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))
    estimate = F.bround((F.length(text) / F.lit(4.0) + words / F.lit(0.75)) / 2, 0).cast("bigint")
    return F.when(words == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), estimate))


def words(text: Column, least: int = 3) -> Column:
    """Topic words in order, with repeats: lower case, no stop words, ``least`` letters or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD), 0)
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*fixed.STOPWORDS))


def terms(text: Column, least: int = 3) -> Column:
    """Distinct topic words, first seen first."""
    return F.array_distinct(words(text, least))


def normalized(text: Column) -> Column:
    """Without byte order mark, with LF line ends, trailing and repeated inner blanks and long blank
    runs, and without line feeds at either end.

    For texts without fenced code and tables; :func:`lakeweave.operators.segments.normalize` protects those.
    """
    t = F.regexp_replace(text, "^\\x{FEFF}", "")
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[ \t\f\x0B]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"(?<=\S)[ \t]{2,}(?=\S)", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"\A\n+|\n+\z", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def paragraphs(text: Column) -> Column:
    """Stripped passages between blank lines."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(t, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")), lambda p: p != "")


def paragraph_key(paragraph: Column) -> Column:
    """White-space runs as one space: equal keys are equal paragraphs."""
    return F.trim(F.regexp_replace(paragraph, r"\s+", " "))


def boilerplate_kind(line: Column) -> Column:
    """The kind of boilerplate a line is as a whole, or null."""
    t = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(fixed.BOILERPLATE):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def language_vote(text: Column) -> Column:
    """pt, es, fr or de by function words: 12 words, 3 hits and 1.5 times the next at least; else null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|[0-9]+"), 0), lambda w: F.lower(w))
    hits = lambda markers: F.size(F.filter(found, lambda w: w.isin(*markers)))
    votes = F.array(*[F.struct(hits(m).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("tag")) for i, (k, m) in enumerate(fixed.LANGUAGE_MARKERS.items())])
    ranked = F.sort_array(votes, asc=False)
    best, second = ranked[0], ranked[1]
    return F.when((F.size(found) >= 12) & (best["n"] >= 3) & (best["n"] > second["n"] * 1.5), best["tag"])


def redacted(text: Column) -> Column:
    """Secrets and identifiers replaced by typed marks, the wider kinds first."""
    return reduce(lambda t, r: F.regexp_replace(t, r[1], f"<{r[0]}>"), fixed.REDACTIONS, text)


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)), F.lit(0))


def cut_at_word(text: Column, limit: int = 1000) -> Column:
    """The first ``limit`` characters, without the word that the limit cuts."""
    head = F.substring(text, 1, limit)
    whole = (F.length(text) <= limit) | F.substring(text, limit + 1, 1).rlike(r"\s")
    return F.when(whole, head).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1), F.lit("")), head))


def size_label(text: Column) -> Column:
    """``N B`` under a kilobyte, else ``N.N KB``, of the UTF-8 bytes."""
    n = F.octet_length(text)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(F.format_string("%.1f KB", F.bround(n / 1024, 1)))


def stash_note(text: Column) -> Column:
    """The note that stands for a text kept elsewhere under its hash."""
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.format_string("[removed: %d lines, %s, id %s]", n_lines, size_label(text), F.substring(F.sha2(text, 256), 1, 12))


def round_half_up(value: Column, unit: float) -> Column:
    return F.floor(value / unit + 0.5) * unit


def gap_bucket(seconds: Column) -> Column:
    """Idle time by bucket; null gives ``unknown``."""
    return F.when(seconds.isNull(), "unknown").when(seconds < 300, "<5m").when(seconds < 3600, "5m-1h").when(seconds < 7200, "1h-2h").when(seconds < 28800, "2h-8h").otherwise(">8h")


def content_type(text: Column) -> Column:
    """A coarse kind of a passage: high_risk, json, xml, markdown_table, yaml, logs, code, config, markdown or prose.

    The looks and their order are fixed values; what begins like JSON or XML counts as such
    though it may be broken, so that it is never cut.
    """
    t = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    ls = F.split(t, "\n")
    hits = lambda kind: F.size(F.filter(ls, lambda x: x.rlike(fixed.LINE_LOOKS[kind])))
    n = F.size(ls)
    looks = (
        (t == "", "prose"),
        (text.rlike(fixed.HIGH_RISK) & (F.length(text) > 200), "high_risk"),
        (t.rlike(r"(?m)^\s*(`{3,}|~{3,})"), "code"),
        (t.rlike(r"^[\[{]"), "json"),
        (t.rlike(r"^<") & t.rlike(r"<[a-zA-Z][^>]*>"), "xml"),
        ((n >= 3) & (hits("markdown_table") > 0), "markdown_table"),
        ((n >= 2) & (hits("yaml") >= F.greatest(F.lit(2), F.floor(n / 2))), "yaml"),
        ((n >= 3) & (hits("logs") >= 2), "logs"),
        ((n >= 2) & (hits("code") > 0), "code"),
        (hits("config") >= 2, "config"),
        (t.rlike(r"^#"), "markdown"),
    )
    return F.coalesce(*[F.when(c, k) for c, k in looks], F.lit("prose"))


def tool_name(tool: Column) -> Column:
    """One spelling of a tool: without server prefix, outer blanks and case."""
    return F.lower(F.regexp_replace(F.trim(tool), r"^mcp__.*?__", ""))
