"""Mixing sources to target shares of the total size.

Every record gets a random key by hash of its id; within each source the records are
ordered by it, sizes are summed up along that order, and the source is cut where its
budget is used up. The order is by ranges of the key: sums per (source, range) are a
small table, a record's place is the sum of the ranges before its own plus the sum
inside its range, so no task holds a source, whatever its share of the rows.

The total is as large as the targets and caps allow: source s can give
``max_repeats * size`` tokens, and the total T with shares w keeps ``w * T`` within that
for all s. A source whose budget is larger than itself is used in whole epochs first,
and the last epoch is cut. A cut is at the record's end that is
nearest to the budget, so a source misses it by half its longest record at most.

Defined results: records without size (null or empty text) are not used; sources without
target or with target 0 are not used; sources with a target but no records are left out
and the other shares are scaled to sum 1, as the report's ``target_share`` and
``wanted_share`` show; source names are compared without outer blanks and case; equal
keys are ordered by id; repeated rows of one id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges of the random key: 2**RANGE_BITS for each source.
RANGE_BITS = 10


def _name(source: Column) -> Column:
    return F.lower(F.trim(source))


def mix(records: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of records (id, source, tokens) and targets (source, target_share, max_repeats).

    selection: (id, source, tokens, times_used); report: one row per target source.
    """
    rows = records.filter(F.col("id").isNotNull() & (F.col("tokens") > 0)).groupBy("id").agg(F.max(F.struct("tokens", _name(F.col("source")).alias("source"))).alias("r")).select("id", "r.source", "r.tokens")
    want = targets.groupBy(_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.join(want.filter("target_share > 0 and max_repeats > 0").select("source"), "source", "left_semi")
    key = F.xxhash64(F.lit(seed), "id")
    rows = rows.withColumn("key", key).withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS))
    sums = rows.groupBy("source", "range").agg(F.sum("tokens").alias("range_tokens"), F.count("*").alias("range_records"))
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("source", "range", F.coalesce(F.sum("range_tokens").over(upto), F.lit(0)).alias("before"))
    size = sums.groupBy("source").agg(F.sum("range_tokens").alias("size"), F.sum("range_records").alias("n_records"))
    plan = want.join(size, "source", "left")
    usable = F.when((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("size") > 0), F.col("target_share"))
    everything = W.partitionBy(F.lit(1))  # one row a source
    plan = plan.withColumn("wanted_share", usable / F.sum(usable).over(everything))
    plan = plan.withColumn("total", F.min(F.col("size") * F.col("max_repeats") / F.col("wanted_share")).over(everything))
    plan = plan.withColumn("budget", F.floor(F.col("wanted_share") * F.col("total") + F.lit(1e-6)))
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("size"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))
    inside = W.partitionBy("source", "range").orderBy("key", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("upto", F.sum("tokens").over(inside)).join(before, ["source", "range"]).withColumn("upto", F.col("upto") + F.col("before"))
    used = placed.join(plan.select("source", "epochs", "rest"), "source")
    used = used.withColumn("times_used", (F.col("epochs") + (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int")).cast("int"))
    selection = used.filter("times_used > 0").select("id", "source", "tokens", "times_used")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times_used")).alias("used_tokens"), F.count("*").alias("used_records"), F.max("times_used").alias("most_used"))
    report = plan.join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = report.select(
        "source", "target_share", "max_repeats", "wanted_share", zero("size").alias("size"), zero("n_records").alias("n_records"), zero("budget").alias("budget"), zero("used_tokens").alias("used_tokens"), zero("used_records").alias("used_records"), zero("most_used").alias("most_used"),
        F.round(zero("used_tokens") / F.sum("used_tokens").over(everything), 6).alias("reached_share"),
    )
    return selection, report
