"""Long exact spans shared between records, by difference-cover anchors.

A character is shared if it lies in a run of ``span`` or more characters that stands
verbatim in another record too. With a difference cover D modulo m, any two positions
i, j have a k < m with i+k and j+k both at cover positions; so two records that share a
run of at least ``span`` characters share the window of ``span - m + 1`` characters at
such an anchor in its first m characters. Only windows at cover positions are hashed.

1. Anchors: every record's anchor windows are hashed, with the hash of the surroundings
   in which any run of ``span`` characters over that anchor must lie. Anchors that stand
   in one record only are dropped; that is most.
2. Where all records that share an anchor have the same surroundings, these are shared
   whole: the match extends over them.
3. Where the surroundings differ, the match is extended to the character: each window of
   ``span`` characters over such an anchor is hashed in every record that holds it, and
   those that two records have are shared. Both records hash them, so nothing is lost.

No pairs of records are made, so a banner in a third of all records costs what any other
anchor costs. Records with equal texts are one text here; two record ids with the same
text of ``span`` or more characters share all of it.

Defined results: null, empty and short texts have no spans; repeated rows of one id count
once (the greatest text if they should differ); columns beside id and text are ignored.
Anchors and windows are compared by hashes of 64 bits, the surroundings of an anchor by 32
more: two of these that differ are taken for equal once in four thousand million shared
anchors, and then only the bounds of a stretch that is shared are off. md5 names a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.arrow import pack
from lakeweave.llm import hashing as H
from lakeweave.sources.tables import total_bytes

#: A perfect difference set: every residue modulo 91 is a difference of two of these.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
BLOCK_CHARS = 4_000_000


def _cover_positions(length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position) of all anchors of texts so long."""
    last = length - window  # the last position where a window fits
    n = np.maximum(0, last // PERIOD + 1)
    cover = np.array(COVER, np.int64)
    doc = np.repeat(np.arange(len(length)), n * len(cover))
    turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pos = (turn[:, None] * PERIOD + cover).ravel()
    ok = pos <= last[doc]
    return doc[ok], pos[ok]


def _anchors(table: pa.Table, span: int) -> pa.RecordBatch:
    window = span - PERIOD + 1
    b = H.Block(table.column("text").to_pylist())
    doc, pos = _cover_positions(b.len, window)
    at = b.off[doc] + pos
    h = b.windows(at, at + window)
    left = np.minimum(pos, PERIOD - 1)
    right = np.minimum(b.len[doc] - pos, span)
    around = b.windows(at - left, at + right) ^ H.mix((left * (span + 1) + right).astype(np.uint64))
    # anchors that two texts of this block hold are shared already; for the other blocks
    # one of them is listed, or two where their surroundings differ
    unlisted, known, known_code = H.distinct(h, doc, around)
    listed = H.listed_entries(len(h), unlisted)
    own = pack(H.key_words(table), b.len, unlisted.astype(np.uint32), known.astype(np.uint32), known_code)
    return H.requests(H.block_number(table), own, h[listed], (around[listed] >> np.uint64(32)).astype(np.uint32))


def _anchor_answers(span: int):
    window = span - PERIOD + 1

    def run(table: pa.Table) -> pa.Table:
        (keys, length, unlisted, known, known_code), place, code, _ = H.read_answers(table)
        doc, pos = _cover_positions(length, window)
        listed = H.listed_entries(len(doc), unlisted)
        index = np.concatenate([known.astype(np.int64), listed[place].astype(np.int64)])
        code = np.concatenate([known_code.astype(np.int64), code.astype(np.int64)])
        # an anchor with two answers takes both: its texts in this block may agree while others differ
        o = np.lexsort((code, doc[index]))
        index, code = index[o], code[o]
        d = doc[index]
        group, first = H.groups(d)
        value = (pos[index] * 2 + (code == 2)).astype(np.int32)
        offsets = np.concatenate([first, [len(value)]]).astype(np.int32)
        key = keys.reshape(-1, 2)[d[first]] if len(first) else np.zeros((0, 2), np.uint64)
        return pa.table([pa.array([k.tobytes() for k in key], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))], names=["key", "anchors"])

    return run


def _extend(table: pa.Table, span: int) -> pa.RecordBatch:
    """Spans that are certain, and the windows to look for elsewhere."""
    b = H.Block(table.column("text").to_pylist())
    anchors = table.column("anchors").combine_chunks()
    size = np.asarray(anchors.value_lengths())
    doc = np.repeat(np.arange(len(size)), size)
    value = np.asarray(anchors.flatten()).astype(np.int64)
    pos, differs = value >> 1, (value & 1) == 1
    lo = np.maximum(pos - (PERIOD - 1), 0)
    sure = (doc[~differs], lo[~differs], np.minimum(pos[~differs] + span, b.len[doc[~differs]]))
    keep = sure[2] - sure[1] >= span
    # runs of window starts over anchors whose surroundings differ
    rd, rs, re_ = H.union_spans(doc[differs], lo[differs], np.minimum(pos[differs], b.len[doc[differs]] - span) + 1)
    ok = re_ > rs
    rd, rs, re_ = rd[ok], rs[ok], re_[ok]
    n = re_ - rs
    wd = np.repeat(rd, n)
    wp = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rs, n)
    at = b.off[wd] + wp
    h = b.windows(at, at + span)
    unlisted, known, _ = H.distinct(h, wd, None)
    listed = H.listed_entries(len(h), unlisted)
    # a text that repeats a window lists it several times in one block; that is no other text
    sd, ss, se = H.union_spans(np.concatenate([sure[0][keep], wd[known]]), np.concatenate([sure[1][keep], wp[known]]), np.concatenate([sure[2][keep], wp[known] + span]))
    run = np.cumsum(np.concatenate([[0], n]))
    own = pack(H.key_words(table), sd, ss, se, rd, rs, run, unlisted.astype(np.uint32))
    return H.requests(H.block_number(table), own, h[listed], None)


def _extend_answers(span: int):
    def run(table: pa.Table) -> pa.Table:
        (keys, sd, ss, se, rd, rs, run_at, unlisted), place, _, _ = H.read_answers(table)
        w = H.listed_entries(int(run_at[-1]), unlisted)[place]
        r = np.searchsorted(run_at, w, "right") - 1
        doc, start = rd[r], rs[r] + (w - run_at[r])
        d, s, e = H.union_spans(np.concatenate([sd, doc]), np.concatenate([ss, start]), np.concatenate([se, start + span]))
        key = keys.reshape(-1, 2)[d]
        return pa.table([pa.array([k.tobytes() for k in key], pa.binary()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["key", "span_start", "span_end"])

    return run


def shared_spans(df: DataFrame, id_col: str = "result_id", text_col: str = "text", span: int = 200) -> DataFrame:
    """(id, n_chars, span_start, span_end): the longest unbroken shared stretches of every record."""
    if span < PERIOD + 16:
        raise ValueError(f"span must be at least {PERIOD + 16}")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= span))
    # the filter on the key stands in both uses of the texts, so that one exchange serves both
    rows = rows.withColumn("key", F.unhex(F.md5("text"))).filter(F.col("key").isNotNull())
    ids = rows.groupBy("id").agg(F.max(F.struct("key", F.length("text").alias("n_chars"))).alias("t")).select("id", "t.*")
    n_tasks = H.task_count(total_bytes(df, text_col))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))

    def list_anchors(batches):
        for block in H.in_blocks(batches, "text", BLOCK_CHARS):
            yield _anchors(block, span)

    def list_windows(batches):
        for block in H.in_blocks(batches, "text", BLOCK_CHARS):
            yield _extend(block, span)

    listed = texts.sortWithinPartitions("key").mapInArrow(list_anchors, H.REQUEST_SCHEMA)
    anchors = H.common_hashes(listed, n_tasks).groupBy("block").applyInArrow(_anchor_answers(span), "key binary, anchors array<int>")
    held = texts.join(anchors, "key").sortWithinPartitions("key").select("key", "text", "anchors")
    windows = held.mapInArrow(list_windows, H.REQUEST_SCHEMA)
    spans = H.common_hashes(windows, n_tasks).groupBy("block").applyInArrow(_extend_answers(span), "key binary, span_start int, span_end int")
    # two ids with one text share all of it, and every id has its text's spans
    copies = ids.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("key", F.lit(True).alias("whole"))
    per_id = ids.join(copies, "key", "left")
    whole = per_id.filter("whole").select("id", "n_chars", F.lit(0).alias("span_start"), F.col("n_chars").alias("span_end"))
    part = per_id.filter("whole is null").join(spans, "key").select("id", "n_chars", "span_start", "span_end")
    return whole.unionByName(part).withColumnRenamed("id", id_col)


def shared_share(df: DataFrame, id_col: str = "result_id", text_col: str = "text", span: int = 200) -> DataFrame:
    """(id, n_chars, n_spans, shared_chars, shared_share): one row per record, also those without spans."""
    per = shared_spans(df, id_col, text_col, span).groupBy(id_col).agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    every = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).alias("n_chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.join(per, id_col, "left").select(id_col, "n_chars", zero("n_spans").alias("n_spans"), zero("shared_chars").alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(zero("shared_chars") / F.col("n_chars"), 4)).alias("shared_share"))
