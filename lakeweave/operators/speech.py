"""Spoken text: what shows it, and what can be taken out without changing what is said.

Removals are spans of the source, so they can be told, merged, applied and undone; nothing
is rewritten.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import text as X
from lakeweave.functions.arrow import map_arrow

# Marks of transcripts, and words that carry nothing.
TIMING = r"^\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3}\s*-->\s*\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3}"
AUDIO_TAG = r"(?i)[\[(](?:music|applause|laughter|silence|inaudible|noise|crosstalk|música|aplausos|risos)[\])]"
STAMP = r"[\[(]\d{1,2}:\d{2}(?::\d{2})?[\])]"
SPEAKER = r"^([A-Z][\w .'-]{0,30}):\s"
FILLERS = re.compile(r"(?i)(?:,\s*)?\b(?:uh+|er+m?|ah+|hm+|uhm+)\b[,.…]*\s?|\b(?:okay|ok) so\b,?\s*|(?<=,)\s*(?:you know|i mean|basically|literally|sort of|kind of|like)\s*,")
TAGS = re.compile(AUDIO_TAG + "|" + STAMP)
REPEATED = re.compile(r"(?i)\b(\w+(?:\s+\w+)?)(?:\s+\1\b)+")


def is_speech(text: Column) -> Column:
    """Timing lines, audio tags, time stamps, two speakers or more, or two kinds of filler."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    speakers = F.array_distinct(F.filter(F.transform(lines, lambda x: F.lower(F.regexp_extract(x, SPEAKER, 1))), lambda x: x != ""))
    fillers = sum(F.contains(F.lower(text), F.lit(m)).cast("int") for m in ("tipo assim", "quer dizer,", " né?", "you know,", "basically,", "literally,", "thanks for watching", "subtitles by"))
    return F.exists(lines, lambda x: x.rlike(TIMING)) | text.rlike(AUDIO_TAG) | text.rlike(STAMP) | (F.size(speakers) >= 2) | (fillers >= 2)


def dictation(text: Column) -> Column:
    """Whether a text reads as dictated: fillers at 3 in 100 words, or one long run of words without a stop."""
    n_words = F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != ""))
    hits = X.count_matches(text, r"(?i)\b(?:uh+|uhm+|umm+|hmm+|you know|i mean|basically|kinda|literally|so yeah)\b")
    stops = F.greatest(F.lit(1), X.count_matches(text, "[.!?]"))
    return ((hits >= 3) & (hits * 100 >= n_words * 3)) | ((n_words >= 40) & (n_words / stops >= 30) & ~F.contains(text, F.lit("\n")))


def removals(df: DataFrame) -> DataFrame:
    """(doc_id, kind, span_start, span_end): fillers, tags and words said twice. Spans may overlap."""
    id_type = dict(df.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, kinds, starts, ends = [], [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            for kind, rx in (("filler", FILLERS), ("tag", TAGS), ("repetition", REPEATED)):
                for m in rx.finditer(t or ""):
                    s = m.end(1) if kind == "repetition" else m.start()
                    at.append(i)
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(m.end())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "kind", "span_start", "span_end"])

    return map_arrow(df.select("doc_id", "text"), run, f"doc_id {id_type}, kind string, span_start int, span_end int")


def remap(offsets: DataFrame, merged: DataFrame) -> DataFrame:
    """(doc_id, offset, source): where a character of the cleaned text stands in the source.

    merged: removed spans that do not overlap. A span counts where it begins at or before the
    source place, which moves on by what is cut; the running sum of cuts gives both.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("span_start")
    cut = F.col("span_end") - F.col("span_start")
    m = merged.withColumn("before", F.coalesce(F.sum(cut).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # in cleaned coordinates a span stands at its start less what was cut before it
    m = m.select("doc_id", (F.col("span_start") - F.col("before")).alias("offset"), (F.col("before") + cut).alias("shift"))
    from lakeweave.operators.spans import as_of

    out = as_of(offsets.select("doc_id", "offset"), m.groupBy("doc_id", "offset").agg(F.max("shift").alias("shift")), "doc_id", "offset", "shift")
    return out.select("doc_id", "offset", (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("source"))
