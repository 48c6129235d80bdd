"""Segmentation and cleaning that need a state machine, one Arrow pass per batch and no shuffle.

Fenced code and tables are *protected*: cleaners leave their lines alone and splitters never
cut inside a fence. Everything a splitter leaves out is a gap, so blocks and gaps together
are the text, character for character.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.functions.arrow import map_arrow
from lakeweave.sources.tables import spread

# Where fenced code begins, a table's delimiter row, and the sizes of blocks.
FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
DELIMITER = re.compile(r"^[ \t]*\|?([ \t]*:?-+:?[ \t]*\|)+[ \t]*(:?-+:?)?[ \t]*\|?[ \t]*$")
INNER_RUN = re.compile(r"(?<=\S)[ \t]{2,}(?=\S)")
BLOCK_MOST, BLOCK_LEAST = 6000, 80


def fences(lines: list[str]) -> list[int]:
    """For each line the number of the fence it belongs to, 0 outside; an open fence goes on to the end."""
    out, number, mark = [], 0, ""
    for line in lines:
        if mark:
            out.append(number)
            body = line.strip()
            if len(body) >= len(mark) and body == mark[0] * len(body):
                mark = ""
            continue
        m = FENCE.match(line)
        if m:
            number, mark = number + 1, m.group(1)
        out.append(number if m else 0)
    return out


def protected(lines: list[str]) -> list[bool]:
    """Which lines are fenced code, or a run of table rows with a delimiter row in it."""
    fenced = fences(lines)
    out = [n > 0 for n in fenced]
    runs = groupby(range(len(lines)), key=lambda i: not fenced[i] and "|" in lines[i])
    for row_like, run in runs:
        rows = list(run)
        if row_like and any(DELIMITER.match(lines[i]) for i in rows):
            for i in rows:
                out[i] = True
    return out


def normalize(text: str) -> tuple[str, dict[str, int]]:
    """Safe white-space cleaning outside protected lines, with counts of what it did."""
    t = text.removeprefix("﻿")
    count = {"bom": len(text) - len(t), "line_ends": t.count("\r"), "trailing": 0, "inner": 0}
    lines = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    keep = protected(lines)
    out: list[str] = []
    blank = 0
    for line, safe in zip(lines, keep):
        if not safe:
            bare = line.rstrip()
            count["trailing"] += bare != line
            line, n = INNER_RUN.subn(" ", bare)
            count["inner"] += n
        blank = blank + 1 if not line and not safe else 0
        if blank < 2:
            out.append(line)
    return "\n".join(out).strip("\n"), count


def paragraphs(text: str) -> list[str]:
    """Blank-line separated paragraphs without their trailing white space; a fence is never cut."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    safe = fences(lines)
    cut = [not f and not x.strip() for f, x in zip(safe, lines)]
    groups = ("\n".join(lines[i] for i in g).rstrip() for blank, g in groupby(range(len(lines)), key=cut.__getitem__) if not blank)
    return [p for p in groups if p.strip()]


def _key(paragraph: str) -> str:
    return " ".join(unicodedata.normalize("NFC", paragraph).split())


GRAM = 8


class _Near:
    """Paragraphs kept so far, found again by the letter groups that a near repeat must share.

    If the matching blocks of two keys cover 95 % of both, at most a twentieth of their
    characters lie outside, and the places of these cut neither key into stretches that are all
    shorter than eight characters. So only kept keys with a letter group in common, in a
    number that follows from the lengths, are compared; one that long passages do not share
    costs nothing.
    """

    def __init__(self, likeness: float):
        self.likeness = likeness
        self.keys: list[str] = []
        self.holders: dict[str, list[int]] = {}

    @staticmethod
    def grams(key: str) -> set[str]:
        return {key[i : i + GRAM] for i in range(len(key) - GRAM + 1)}

    def has_like(self, key: str) -> bool:
        met = Counter(i for g in self.grams(key) for i in self.holders.get(g, ()))
        matcher = SequenceMatcher(None, "", key)
        for i, shared in sorted(met.items(), key=lambda x: -x[1]):
            both = len(self.keys[i]) + len(key)
            outside = (1 - self.likeness) * both
            if abs(len(self.keys[i]) - len(key)) > outside:
                continue
            matcher.set_seq1(self.keys[i])
            if matcher.quick_ratio() >= self.likeness and matcher.ratio() >= self.likeness:
                return True
        return False

    def add(self, key: str) -> None:
        for g in self.grams(key):
            self.holders.setdefault(g, []).append(len(self.keys))
        self.keys.append(key)


def near_unique(text: str, likeness: float = 0.95, least: int = 40) -> tuple[list[str], int, int]:
    """(kept paragraphs, exact repeats, near repeats), the first of each kept, in order.

    Paragraphs with one key are repeats; those whose keys, without case, have ``least``
    characters or more are near repeats when their matching-blocks ratio reaches the likeness.
    """
    kept: dict[str, str] = {}
    near = _Near(likeness)
    exact = alike = 0
    for p in paragraphs(text):
        key = _key(p)
        small = key.lower()
        if key in kept:
            exact += 1
        elif len(key) >= least and near.has_like(small):
            alike += 1
        else:
            kept[key] = p
            if len(key) >= least:
                near.add(small)
    return list(kept.values()), exact, alike


def block_spans(text: str, most: int = BLOCK_MOST) -> list[tuple[int, int]]:
    """Spans of blocks: runs of filled lines and whole fences, at most ``most`` characters where a line end allows it."""
    lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", text)
    safe = fences([x.rstrip("\r\n") for x in lines])
    spans: list[tuple[int, int]] = []
    at = 0
    last: object = None
    for line, fence in zip(lines, safe):
        kind: object = fence or (None if not line.strip() else "text")
        if kind is None:
            last = None
        elif kind == last:
            spans[-1] = (spans[-1][0], at + len(line))
        else:
            spans.append((at, at + len(line)))
            last = kind
        at += len(line)
    return [piece for s, e in spans for piece in _pieces(text, s, e, most)]


LINE_END = re.compile(r"\r\n|\r|\n")


def _pieces(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """A span in pieces of ``most`` characters at most: each ends at the last line end in its second half, if there is one.

    No line end is cut in two, and a rest of less than BLOCK_LEAST stays with the piece before.
    """
    stops = [m.end() for m in LINE_END.finditer(text, start, end)] if end - start > most else []
    borders = [start]
    while end - borders[-1] > most:
        full = borders[-1] + most
        whole = full + (text[full - 1 : full + 1] == "\r\n")
        last = bisect_right(stops, whole) - 1
        in_half = last >= 0 and stops[last] > full - (most - most // 2)
        borders.append(stops[last] if in_half else whole)
    if len(borders) > 1 and end - borders[-1] < BLOCK_LEAST:
        borders.pop()
    return list(zip(borders, [*borders[1:], end]))


def block_id(index: int, text: str) -> str:
    return f"blk_{index:04d}_{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def blocks(df: DataFrame, most: int = BLOCK_MOST) -> DataFrame:
    """(doc_id, idx, block_id, gap_before, text, char_start, char_end, is_protected, reason).

    The gap after the last block is a row of its own, with null text and block_id.
    """
    id_type = dict(df.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, t in enumerate(batch.column("text").to_pylist()):
            end = 0
            spans = block_spans(t, most) if t else []
            for n, (s, e) in enumerate(spans, 1):
                body = t[s:e]
                short = len(body) < BLOCK_LEAST
                rows.append((i, n, block_id(n, body), t[end:s], body, s, e, short, "short_block" if short else None))
                end = e
            if t and end < len(t):
                rows.append((i, len(spans) + 1, None, t[end:], None, len(t), len(t), True, "gap"))
        cols = list(zip(*rows)) or [()] * 9
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(arrays[0]), *arrays[1:]], names=["doc_id", "idx", "block_id", "gap_before", "text", "char_start", "char_end", "is_protected", "reason"])

    return map_arrow(spread(df.select("doc_id", "text")), run, f"doc_id {id_type}, idx int, block_id string, gap_before string, text string, char_start int, char_end int, is_protected boolean, reason string")


def rebuilt(parts: DataFrame) -> DataFrame:
    """(doc_id, text): blocks and gaps put together again."""
    piece = F.struct("idx", F.concat("gap_before", F.coalesce("text", F.lit(""))).alias("t"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "").alias("text"))


def cleaned(df: DataFrame, likeness: float = 0.95) -> DataFrame:
    """(doc_id, text, n_trailing, n_inner, n_exact, n_near): normalized and without repeated or nearly repeated paragraphs."""
    id_type = dict(df.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column("text").to_pylist():
            clean, count = normalize(t or "")
            kept, exact, near = near_unique(clean, likeness)
            rows.append(("\n\n".join(kept), count["trailing"], count["inner"], exact, near))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["doc_id", "text", "n_trailing", "n_inner", "n_exact", "n_near"])

    return map_arrow(spread(df.select("doc_id", "text")), run, f"doc_id {id_type}, text string, n_trailing int, n_inner int, n_exact int, n_near int")


# --- sentences ------------------------------------------------------------------------------

# Cues by which a sentence asks or sets a rule, and which shift the topic.
ASK = r"(?i)\b(?:please|i want|i need|we need|need to|can you|could you|make sure)\b|(?:^|[.!?;:,]\s*|\b(?:and|also|then|just|now|please)\s+)(?:fix|add|create|write|update|remove|refactor|rename|implement|measure|open|document|review|run|migrate|explain|check|investigate|delete|deploy|change|move|compare|generate|make)\b"
RULE = r"(?i)^(?:do not|don't|never|only|keep|avoid|without|must not|search)\b|\b(?:must be|has to be|should be|needs to be)\b"
SHIFT = r"(?i)^(?:anyway|by the way|another thing|also|besides|changing topic)\b"


def sentences(df: DataFrame) -> DataFrame:
    """(doc_id, idx, sentence, role, topic): sentences with their role and topic block.

    role is ask, constraint or context; a new topic begins at a shift cue, or where a sentence
    has no topic stem (the first five letters of words of four and more) of the one before.
    """
    found = F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]*"), 0)
    rows = spread(df.select("doc_id", "text")).filter("text is not null").select("doc_id", F.posexplode(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s.rlike(r"\w"))).alias("idx", "sentence"))
    s = F.col("sentence")
    role = F.when(s.rlike(r"\?$"), "ask").when(s.rlike(RULE), "constraint").when(s.rlike(ASK), "ask").otherwise("context")
    stems = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}{4,}"), 0), lambda w: F.substring(w, 1, 5)))
    w = W.partitionBy("doc_id").orderBy("idx")
    rows = rows.withColumn("role", role).withColumn("stems", stems)
    before = F.lag("stems").over(w)
    new = before.isNull() | s.rlike(SHIFT) | ~F.arrays_overlap("stems", before)
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    return rows.withColumn("topic", F.sum("new").over(w)).drop("stems", "new")
