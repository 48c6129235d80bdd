"""Parquet tables by name, and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the folder; column pruning and filters reach its scan."""
    safe_unions(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def safe_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of equally partitioned inputs to be partitioned so too, though adaptive
    execution may have put their partitions together differently: groups then come apart. Off for this session."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (master ``local``) a folder is made where that setting is absent; a
    cluster without it is an error, for no machine's own folder is seen by all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _MADE.get("folder")
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _MADE["folder"] = "file://" + tempfile.mkdtemp(prefix="lakeweave-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder


_MADE: dict[str, str] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there.

    The written copy outlives any executor, so a later loss never recomputes
    what lies before it.
    """
    spark = df.sparkSession
    safe_unions(spark)
    path = f"{shared_dir(spark).rstrip('/')}/lakeweave/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove(path: str) -> None:
    """Delete a folder. Where the file system is none that pyarrow knows, it stays until the shared folder is emptied."""
    with contextlib.suppress(ValueError, OSError, pa.ArrowException):
        system, place = FileSystem.from_uri(path)
        system.delete_dir(place)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        remove(path)


def total_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of the column: four times the files' size where the plan reads files, else counted by a job.

    Only how many tasks share the work depends on it, never what they find.
    """
    if not hasattr(df, "_jdf"):  # a remote session shows no statistics
        return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 60:
        return 4 * estimate
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


#: Below this the rows of a few files are dealt out to all cores before work on each of them.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input is small, so that one file is no single task; else as they are.

    A large input has tasks enough and is not shuffled. What comes out is the same.
    """
    if not hasattr(df, "_jdf"):
        return df
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < estimate < SMALL_BYTES and cores > 1 else df
