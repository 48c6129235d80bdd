"""Streams of session events: dedup, idle sessions, windows and sticky decisions.

Event time is ``ts``. Late rows are taken up to the watermark; later ones are dropped by
these operators, which is this engine's own rule: a batch run over the same rows drops none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeweave.sources.tables import remove, shared_dir


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of files, with the schema the batch reader has."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def once(stream: DataFrame, key: str, delay: str = "30 days") -> DataFrame:
    """Rows with a new key; keys are kept until the watermark has passed them."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def idle_sessions(stream: DataFrame, key: str, gap: str, delay: str = "30 days") -> DataFrame:
    """(key, started, ended, n): activity without a break of ``gap``."""
    s = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "total")


def windows(stream: DataFrame, key: str, width: str, slide: str | None = None, delay: str = "30 days") -> DataFrame:
    """(key, window_start, n, total) in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    s = stream.withWatermark("ts", delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return s.select(key, F.col("w.start").alias("window_start"), "n", "total")


def sticky(stream: DataFrame, key: str, item: str, limit: int = 2) -> DataFrame:
    """(key, item, nth): the first ``limit`` times a key shows an item; further ones are muted.

    What was shown is state by key: a decision once given is never taken back, and a restart
    goes on from the checkpoint.
    """
    k_type, i_type = dict(stream.dtypes)[key], dict(stream.dtypes)[item]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, counts = state.get if state.exists else ([], [])
        shown = dict(zip(items, counts))
        rows = []
        for x in sorted(v for f in frames for v in f[item].dropna().tolist()):
            n = shown.get(x, 0)
            if n < limit:
                shown[x] = n + 1
                rows.append((k[0], x, n + 1))
        state.update((list(shown), list(shown.values())))
        yield pd.DataFrame(rows, columns=[key, item, "nth"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {k_type}, {item} {i_type}, nth int", f"items array<{i_type}>, counts array<int>", "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, as a batch: the stream is run to its end into the shared folder.

    In complete mode each batch replaces the last one's result.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/lakeweave/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    remove(f"{base}/state")  # the stream is at its end
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
