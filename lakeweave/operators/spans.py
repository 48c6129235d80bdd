"""Joins and unions over intervals and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, key: str, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """(key, start, end, n): overlapping or touching spans of a key as one; empty spans are left out."""
    w = W.partitionBy(key).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = spans.filter(F.col(end) > F.col(start)).select(key, start, end).withColumn("_new", (far.isNull() | (F.col(start) > far)).cast("int"))
    s = s.withColumn("_island", F.sum("_new").over(w))
    return s.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Rows (key, ls, le, rs, re) of spans of one key that overlap.

    Each span is laid into the buckets of ``width`` it touches and the join is by (key,
    bucket); a pair is told in the first bucket both touch, so it comes out once. A
    key with very many spans is thereby many join keys.
    """
    lay = lambda d, s, e: d.filter(F.col(e) > F.col(s)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    l = lay(left.select(key, F.col("span_start").alias("ls"), F.col("span_end").alias("le")), "ls", "le")
    r = lay(right.select(key, F.col("span_start").alias("rs"), F.col("span_end").alias("re")), "rs", "re")
    both = l.join(r, [key, "_b"]).filter((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
    return both.filter(F.col("_b") == F.floor(F.greatest("ls", "rs") / width)).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the right row's ``value`` that is the last one at or before each row's time.

    One sort by (key, time) over the union in place of a join by range: right rows go before
    left rows of the same time.
    """
    l = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = W.partitionBy("_k").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", F.col("_v").alias(value))


def removed(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, text): the texts without the spans; spans may overlap."""
    m = merge_spans(spans, key)
    lists = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("cut"))
    t = texts.join(lists, key, "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["span_end"].cast("bigint").alias("at"), F.concat(acc["out"], F.substring("text", acc["at"].cast("int") + 1, (s["span_start"] - acc["at"]).cast("int"))).alias("out"))
    done = F.aggregate("cut", start, step)
    rest = F.concat(done["out"], F.substring("text", done["at"].cast("int") + 1, F.length("text")))
    return t.select(key, F.when(F.col("cut").isNull(), F.col("text")).otherwise(rest).alias("text"))
