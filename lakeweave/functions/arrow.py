"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Several one-dimensional arrays as one binary value."""
    head = [np.array([len(arrays)], np.int64)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = a.dtype.str.encode().ljust(8)
        head += [np.frombuffer(kind, np.int64), np.array([len(a)], np.int64)]
        body.append(a.tobytes())
    return np.concatenate(head).tobytes() + b"".join(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 1 + 2 * n)
    at, out = 8 * (1 + 2 * n), []
    for i in range(n):
        kind = np.dtype(head[1 + 2 * i : 2 + 2 * i].tobytes().strip().decode())
        size = int(head[2 + 2 * i])
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * kind.itemsize
    return out
