"""Vectors: checks before an index is used, and nearest neighbours of a stated query set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check(df: DataFrame, dims: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(reason, n): ok, null_id, duplicate_id, null_vector, wrong_dims, not_finite or zero; the first that holds."""
    v = F.col(vec)
    n = F.count("*").over(W.partitionBy(key))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (
        F.when(F.col(key).isNull(), "null_id").when(n > 1, "duplicate_id").when(v.isNull(), "null_vector").when(F.size(v) != dims, "wrong_dims")
        .when(bad, "not_finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("ok")
    )
    return df.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding", key: str = "vec_id", block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows of greatest cosine for every query, itself left out.

    Both sides are packed into blocks; every query block meets every row block, one matrix
    product each, and only k rows a query leave it. Blocks are spread by hash, so no task holds
    a side. Exact: this is the stated query set against all rows.
    """

    def packed(df: DataFrame, n: int) -> DataFrame:
        b = df.filter(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("b"))
        return b.groupBy("b").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("flat"))

    count = rows.count()
    n_rows, n_queries = max(1, -(-count // block)), max(1, -(-queries.count() // block))
    r = packed(rows, n_rows).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    q = packed(queries, n_queries).select(F.col("b").alias("q"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, q_ids = (np.asarray(batch.column(c)[i].values) for c in ("ids", "q_ids"))
                a, b = (np.asarray(batch.column(c)[i].values).reshape(len(n), -1) for c, n in (("flat", ids), ("q_flat", q_ids)))
                s = (b / np.linalg.norm(b, axis=1, keepdims=True)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T
                s = np.round(s, 6)
                s[q_ids[:, None] == ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, : k + 1]
                score = np.take_along_axis(s, order, 1)
                ok = score > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, ok.sum(1))), pa.array(ids[order][ok]), pa.array(score[ok])], names=["query_id", "vec_id", "score"])

    parts = r.join(q, "q").select("ids", "flat", "q_ids", "q_flat").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k)
