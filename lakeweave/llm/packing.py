"""Filling containers of fixed capacity by minimum bin slack.

Only lengths matter for which items fit together, and there are at most ``capacity``
lengths, however many items. So the whole corpus is packed from its histogram: the
longest length left opens a container, and a subset-sum over the lengths left finds the
multiset that fills the rest closest to capacity. The sums reachable are the bits of one
integer, a length's copies are added by shifts in powers of two, and walking back through
the integers gives the counts of each length. The pattern found is used as often as the
counts left allow, so the number of patterns follows the lengths, not the items.

Items get their places by rank: items of one length are ranked by (bucket, id), bucket
sizes are summed in a small table, and a pattern owns a range of ranks of each length it
holds. No task holds all items of a length.

An item longer than the capacity is cut into pieces of the capacity and a rest; no other
item is cut. Defined results: items of size 0 or null (empty texts) take no space and are
not placed; repeated rows of one id count once; ties in the order go by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the greatest up to ``room``.

    Lengths are taken from the longest down and the search ends as soon as the room can be
    filled exactly; then it fills with few, long items.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] > 0 and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            grown = (reach | reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        # the sum was reachable without these copies, or it was reached by them
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= take * length
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how often) until every item is placed, by minimum bin slack."""
    left = {x: n for x, n in histogram.items() if n > 0}
    if any(x > capacity or x <= 0 for x in left):
        raise ValueError("lengths must lie in 1..capacity")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((chosen, times))
    return out


def _plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks that patterns own, as arrays sorted by (length, rank)."""
    rows, used, bin_no = [], {}, 0
    for chosen, times in patterns(histogram, capacity):
        for x, n in chosen.items():
            first = used.get(x, 0)
            rows.append((x, first, n, bin_no))
            used[x] = first + n * times
        bin_no += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "each": a[:, 2], "bin": a[:, 3]}


def pack_items(items: DataFrame, capacity: int, container: str = "container", buckets: int = 64) -> DataFrame:
    """(container, capacity, bin_id, id, piece, n_pieces, tokens) of items (id, tokens).

    The histogram has at most ``capacity`` rows, so bringing it to the driver is bounded by
    the parameter, not by the data; so is the plan that goes to the executors.
    """
    rows = items.filter(F.col("id").isNotNull() & (F.col("tokens") > 0)).groupBy("id").agg(F.max("tokens").alias("tokens"))
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    rest = (F.col("tokens") - whole * capacity).cast("int")
    n_pieces = whole + F.when(rest > 0, 1).otherwise(0)
    piece = F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece")
    rows = rows.select("id", n_pieces.alias("n_pieces"), piece, rest.alias("rest"), whole.alias("whole"))
    rows = rows.select("id", "piece", "n_pieces", F.when(F.col("piece") < F.col("whole"), F.lit(capacity)).otherwise(F.col("rest")).cast("int").alias("length"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _plan(histogram, capacity)
    upto = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "piece")) - 1
    ranked = rows.withColumn("inside", inside).join(before, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "n_pieces", "length", (F.col("before") + F.col("inside")).alias("rank"))
    id_type = dict(ranked.dtypes)["id"]

    def place(batches):
        lift = np.int64(1) << 44
        key = plan["length"] * lift + plan["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length * lift + rank, "right") - 1
            bin_id = plan["bin"][at] + (rank - plan["rank"][at]) // plan["each"][at]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([container] * n), pa.array([capacity] * n, pa.int32()), pa.array(bin_id), batch.column("id"), batch.column("piece"), batch.column("n_pieces"), pa.array(length.astype(np.int32))],
                names=["container", "capacity", "bin_id", "id", "piece", "n_pieces", "tokens"],
            )

    return ranked.mapInArrow(place, f"container string, capacity int, bin_id long, id {id_type}, piece int, n_pieces int, tokens int")


def slack(packed: DataFrame) -> DataFrame:
    """(container, capacity, n_bins, n_pieces, tokens, unused, unused_share, n_full) per container size."""
    bins = packed.groupBy("container", "capacity", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    out = bins.groupBy("container", "capacity").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") == F.col("capacity")).alias("n_full"))
    room = F.col("n_bins") * F.col("capacity")
    return out.withColumn("unused", room - F.col("tokens")).withColumn("unused_share", F.round(F.col("unused") / room, 6))
