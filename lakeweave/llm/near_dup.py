"""Near-duplicate records by segment popcounts and a grid range join, verified exactly.

A record's fingerprint is the bit set of its distinct word shingles, hashed to 64 bits.

1. *Own bits.* Which bits other records hold too is asked of an exchange of their hashes. A
   bit that one record alone holds is a certain difference to any other record: a record with
   more than ``1 - t`` of them is alike to none, and two records may together have no more than
   ``k * (a + b)``, for records of a and b bits and ``k = (1 - t) / (1 + t)``. So records that share
   a banner but are their own otherwise leave here, whatever the number of them.
2. *Embedding.* The other bits are cut into bands of ``SEGMENTS`` segments, and a record becomes
   its count of set bits in each segment. The Manhattan distance of two such vectors never
   exceeds the number of bits in which the records differ, at most ``k * (a + b)``.
3. *Grid range join.* A band is a grid with a cell for each vector of counts. Of ``m`` bands all
   but ``SPARE`` would have to differ by two or more to lose a pair, and ``2 * (m - SPARE + 1)`` exceeds the
   distance allowed: so a pair comes within distance 1 in SPARE bands at least. Each record
   stands in the cell of its vector and reaches into those of its vectors with one count
   less; that joins all vectors within distance 1. The number of bands follows the record's
   size, on a grid of its own size and the next smaller one, so any two sizes within t meet.
4. *Verification.* Pairs within the Manhattan bound are compared bit by bit, all bits.

Empty vectors are no cell. A pair is lost only if one of its records is empty in every band
in which they come within distance 1; where bands are few, two independent cuts into
bands are used, and the chance stays below one in ten million for pairs at the threshold.

A cell of more than ``HOT`` members is split: its members get a salt, each pair of salts is a
group of its own, and pairs are compared within the bound before they leave it. No pair is left out.

Records with one text are one record here; :func:`alike_pairs` gives pairs of texts,
:func:`expand` gives every pair of ids, :func:`alike_groups` a class for every record.

Defined results: null, empty and short texts (fewer than ``min_words`` words) are alike to
none; repeated rows of one id count once; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.arrow import pack
from lakeweave.llm import hashing as H
from lakeweave.sources.tables import discard, materialize, total_bytes

SEGMENTS = 1 << 16
SPARE = 3
#: Fewer bands than this are cut twice.
FEW_BANDS = 16
#: Segments of the whole vector that pairs are held against before they are verified.
COARSE = 64
HOT = 1024
BITS_AT_ONCE = 200_000
BLOCK_CHARS = 4_000_000


def shingles(texts: list[str], words: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct runs of ``words`` words, sorted; short texts have none.

    Words are the pieces between spaces, tabs, CR and LF once U+FEFF is removed.
    """
    clean = [t.replace("﻿", "") if "﻿" in t else t for t in texts]
    b = H.Block([t + "\n" for t in clean])
    codes = np.frombuffer("\n".join([*clean, ""]).encode("utf-32-le"), np.uint32)
    gap = (codes == 32) | (codes == 9) | (codes == 10) | (codes == 13)
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    doc = np.searchsorted(b.off, start, "right") - 1
    word = b.windows(start, end)
    count = np.bincount(doc, minlength=len(texts))
    n = max(0, len(word) - words + 1)
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h = H.mix(h * np.uint64(0x100000001B3) + word[i : i + n])
    same = (doc[:n] == doc[words - 1 : words - 1 + n]) & (count[doc[:n]] >= min_words)
    d, h = doc[:n][same], h[same]
    o = np.lexsort((h, d))
    d, h = d[o], h[o]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, bool)
    return d[new], h[new]


def _grid(n: np.ndarray, likeness: float) -> np.ndarray:
    """The grid of a record of n bits: sizes within a factor ``likeness`` are at most one apart."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1 / likeness) + 1e-9).astype(np.int64)


def share_of_difference(likeness: float) -> float:
    """k: alike records of a and b bits differ in at most k * (a + b) of them."""
    return (1 - likeness) / (1 + likeness)


def n_bands(grid: np.ndarray, likeness: float) -> np.ndarray:
    """Bands of a grid, for the greatest distance two records that meet on it may have."""
    smallest = (1 / likeness) ** grid
    farthest = share_of_difference(likeness) * smallest * (1 / likeness + 1 / likeness**2)
    return np.floor(farthest / 2).astype(np.int64) + SPARE


BELOW, LESS, HIGH = 1, 2, 4


def cells(doc: np.ndarray, h: np.ndarray, n: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, cell, flags) of each band's vector and of its vectors with one count less, on the record's grid and the one below.

    doc, h: the bits that others hold too; n: all bits of each record. A cell's name is
    linear in the counts, so a count less is a subtraction.
    """
    out = []
    own = _grid(n, likeness)
    for below in (0, BELOW):
        grid = own - below
        bands = n_bands(np.maximum(grid, 0), likeness)
        for turn in (0, 1):
            mine = ((grid >= 0) & ((turn == 0) | (bands < FEW_BANDS)))[doc]
            d, x = doc[mine], H.mix(h[mine] + np.uint64(turn * 0x9E37 + 1))
            band = ((x >> np.uint64(32)) * bands[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            part = H.mix((x & np.uint64(SEGMENTS - 1)) + np.uint64(1))
            o = np.lexsort((part, band, d))
            d, band, part = d[o], band[o], part[o]
            if not len(d):
                continue
            label = d * (int(bands.max()) + 1) + band
            group, first = H.groups(label)
            name = np.add.reduceat(part, first)
            tag = H.mix(((grid[d[first]] * 2 + turn) << 32).astype(np.uint64) + band[first].astype(np.uint64))
            out.append((d[first], H.mix(name + tag), np.full(len(first), below)))
            # one count less: once for each set segment, if something is left
            size = np.diff(np.concatenate([first, [len(d)]]))
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (group[1:] != group[:-1])]) & (size[group] > 1)
            out.append((d[new], H.mix((name[group] - part + tag[group])[new]), np.full(int(new.sum()), below | LESS)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def popcounts(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """The coarse vector: set bits in each of COARSE segments, up to 255."""
    at = doc * COARSE + (h >> np.uint64(64 - COARSE.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n_docs * COARSE), 255).reshape(n_docs, COARSE).astype(np.uint8)


def within_bound(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the Manhattan distance of popcount vectors is at most ``most``."""
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(1) <= most + 1e-6


def _list_bits(table: pa.Table, words: int, min_words: int) -> pa.RecordBatch:
    doc, h = shingles(table.column("text").to_pylist(), words, min_words)
    n = np.bincount(doc, minlength=table.num_rows)
    unlisted, known, _ = H.distinct(h, doc, None)
    own = pack(H.key_words(table), n.astype(np.uint32), unlisted.astype(np.uint32), known.astype(np.uint32), h[known])
    return H.requests(H.block_number(table), own, h[H.listed_entries(len(h), unlisted)], None)


BITS_SCHEMA = "key binary, rid long, n int, u int, counts binary, bits binary"


def _shared_bits(likeness: float):
    """(key, rid, n, u, counts, bits) of records that may be alike to another: all their bits but the u that are theirs alone."""

    def run(table: pa.Table) -> pa.Table:
        (keys, n, unlisted, known, known_h), place, _, told = H.read_answers(table)
        n = n.astype(np.int64)
        entry = np.concatenate([known.astype(np.int64), H.listed_entries(int(n.sum()), unlisted)[place]])
        h = np.concatenate([known_h, told])
        entry, at = np.unique(entry, return_index=True)
        h = h[at]
        doc = np.searchsorted(np.cumsum(n), entry, "right")
        shared = np.bincount(doc, minlength=len(n))
        may = (n > 0) & (shared >= likeness * n - 1e-9)
        doc, h = doc[may[doc]], h[may[doc]]
        counts = popcounts(doc, h, len(n))
        cut = np.searchsorted(doc, np.arange(len(n) + 1))
        rows = np.nonzero(may)[0]
        names = keys.reshape(-1, 2)
        return pa.table(
            [
                pa.array([names[i].tobytes() for i in rows], pa.binary()), pa.array(names[rows, 0].view(np.int64)), pa.array(n[rows].astype(np.int32)), pa.array((n - shared)[rows].astype(np.int32)),
                pa.array([counts[i].tobytes() for i in rows], pa.binary()), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()),
            ],
            names=["key", "rid", "n", "u", "counts", "bits"],
        )

    return run


MEMBER_SCHEMA = "cell long, rid long, n int, u int, flags int"


def _members(likeness: float):
    def run(batches):
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                # so many records at a time as have a bounded number of bits
                ends = np.cumsum([len(x) // 8 for x in whole.column("bits")[at : at + 4096].to_pylist()])
                batch = whole.slice(at, max(1, int(np.searchsorted(ends, BITS_AT_ONCE, "right"))))
                at += batch.num_rows
                bits = [np.frombuffer(x, np.uint64) for x in batch.column("bits").to_pylist()]
                doc = np.repeat(np.arange(len(bits)), [len(x) for x in bits])
                n = np.asarray(batch.column("n")).astype(np.int64)
                d, cell, flags = cells(doc, np.concatenate(bits), n, likeness)
                row = pa.array(d)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *(batch.column(c).take(row) for c in ("rid", "n", "u")), pa.array(flags.astype(np.int32))], names=["cell", "rid", "n", "u", "flags"])

    return run


def _may_pair(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, likeness: float) -> np.ndarray:
    """Whether two members of a cell are within distance 1 there, of the grid's sizes, and leave each other a chance."""
    n, u, f = cols["n"], cols["u"], cols["flags"]
    ok = ((f[i] & f[j] & (BELOW | LESS)) == 0) & (cols["rid"][i] != cols["rid"][j])
    ok &= np.minimum(n[i], n[j]) >= likeness * np.maximum(n[i], n[j]) - 1e-9
    most = share_of_difference(likeness) * (n[i] + n[j]) - u[i] - u[j]
    ok &= most >= -1e-6
    if "side" in cols:
        ok &= (cols["lo"][i] == cols["hi"][i]) | (cols["side"][i] != cols["side"][j])
        i, j, at = i[ok], j[ok], np.nonzero(ok)[0]
        ok[at] = within_bound(cols["counts"][i], cols["counts"][j], most[at])
    return ok


def _pairs_of(cols: dict[str, np.ndarray], group: np.ndarray, likeness: float):
    """Batches of pairs of the rows of each group; group numbers are sorted."""
    alive, step = np.arange(len(group)), 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(group)]
        alive = alive[group[alive] == group[alive + step]]
        i = alive[_may_pair(cols, alive, alive + step, likeness)]
        if len(i):
            a, b = cols["rid"][i], cols["rid"][i + step]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pair[:, 0], pair[:, 1]


def _whole_groups(batches, names: list[str], same: tuple[str, ...]):
    """The rows of sorted batches as columns, group by group: no group is cut between two yields."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {}
        for c in names:
            col = batch.column(c)
            cols[c] = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, COARSE) if c == "counts" else np.asarray(col).astype(np.int64)
        held.append(cols)
        if all(cols[c][-1] == held[0][c][0] for c in same):
            continue
        cols = {c: np.concatenate([x[c] for x in held]) for c in names}
        last = np.logical_and.reduce([cols[c] == cols[c][-1] for c in same])
        cut = int(last.argmax())
        yield {c: v[:cut] for c, v in cols.items()}
        held = [{c: v[cut:] for c, v in cols.items()}]
    if held:
        yield {c: np.concatenate([x[c] for x in held]) for c in names}


def _group_numbers(cols: dict[str, np.ndarray], same: tuple[str, ...]) -> np.ndarray:
    new = np.logical_or.reduce([np.concatenate([[True], cols[c][1:] != cols[c][:-1]]) for c in same])
    return np.cumsum(new) - 1


PAIR_SCHEMA = "rid_a long, rid_b long, " + MEMBER_SCHEMA


def _pairs_or_members(likeness: float):
    """Rows sorted by cell: pairs of the cells of ``HOT`` members at most, the members of all others."""

    def run(batches):
        names = ["cell", "rid", "n", "u", "flags"]
        kinds = {"cell": pa.int64(), "rid": pa.int64(), "n": pa.int32(), "u": pa.int32(), "flags": pa.int32()}
        hot = None  # a cell known to be crowded, of which more may come
        held: dict[str, np.ndarray] | None = None

        def through(cols):
            k = len(cols["cell"])
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), *(pa.array(cols[c], kinds[c]) for c in names)], names=["rid_a", "rid_b", *names])

        def pairs(cols):
            group = _group_numbers(cols, ("cell",))
            size = np.bincount(group)
            crowded = size[group] > HOT
            if crowded.any():
                yield through({c: v[crowded] for c, v in cols.items()})
                cols, group = {c: v[~crowded] for c, v in cols.items()}, group[~crowded]
            for a, b in _pairs_of(cols, group, likeness):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), kinds[c]) for c in names)], names=["rid_a", "rid_b", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: np.asarray(batch.column(c)).astype(np.int64) for c in names}
            if hot is not None:
                more = cols["cell"] == hot
                if more.any():
                    yield through({c: v[more] for c, v in cols.items()})
                    cols = {c: v[~more] for c, v in cols.items()}
                if not len(cols["cell"]):
                    continue
                hot = None
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
            cut = int(np.searchsorted(cols["cell"], cols["cell"][-1]))
            yield from pairs({c: v[:cut] for c, v in cols.items()})
            held = {c: v[cut:] for c, v in cols.items()}
            if len(held["cell"]) > HOT:
                hot = int(held["cell"][0])
                yield through(held)
                held = None
        if held is not None:
            yield from pairs(held)

    return run


def _hot_pairs(likeness: float):
    """Pairs within the bound of rows sorted by (cell, lo, hi)."""
    same = ("cell", "lo", "hi")

    def run(batches):
        for cols in _whole_groups(batches, ["cell", "lo", "hi", "side", "rid", "n", "u", "flags", "counts"], same):
            for a, b in _pairs_of(cols, _group_numbers(cols, same), likeness):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["rid_a", "rid_b"])

    return run


def candidates(bits: DataFrame, likeness: float) -> tuple[DataFrame, DataFrame]:
    """(rid_a, rid_b), rid_a < rid_b, of all records that share a cell and may be alike; and the written rows it reads."""
    members = bits.select("bits", "rid", "n", "u").mapInArrow(_members(likeness), MEMBER_SCHEMA)
    met = materialize(members.repartition("cell").sortWithinPartitions("cell").mapInArrow(_pairs_or_members(likeness), PAIR_SCHEMA), "alike-met")
    pairs = met.filter("cell is null").select("rid_a", "rid_b")
    hot = met.filter("cell is not null").drop("rid_a", "rid_b")
    # a member meets every salt of its cell, in the group named by both salts; counts are summed before they move
    size = hot.groupBy("cell").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"))
    hot = hot.join(size, "cell").join(bits.select("rid", "counts"), "rid")
    mine = F.pmod(F.xxhash64("rid", "cell"), F.col("salts")).cast("int")
    hot = hot.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    hot = hot.select("cell", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rid", "n", "u", "flags", "counts")
    more = hot.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(_hot_pairs(likeness), "rid_a long, rid_b long")
    return pairs.unionByName(more).distinct(), met


def _verify(likeness: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, u = (np.asarray(batch.column(f"{c}_a")).astype(np.int64) + np.asarray(batch.column(f"{c}_b")) for c in ("n", "u"))
            a, b = (np.frombuffer(b"".join(batch.column(f"counts_{x}").to_pylist()), np.uint8).reshape(-1, COARSE) for x in "ab")
            score = np.zeros(batch.num_rows)
            left, right = batch.column("bits_a"), batch.column("bits_b")
            for i in np.nonzero(within_bound(a, b, share_of_difference(likeness) * n - u))[0]:
                x, y = np.frombuffer(left[int(i)].as_py(), np.uint64), np.frombuffer(right[int(i)].as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                score[i] = both / max(1, int(n[i]) - both)
            out = pa.RecordBatch.from_arrays([batch.column("key_a"), batch.column("key_b"), pa.array(score)], names=["key_a", "key_b", "likeness"])
            yield out.filter(pa.array(score >= likeness))

    return run


def _texts(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, long_enough), key naming the text, and the distinct texts (key, text)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    # so many words: U+FEFF begins none, and ends none
    enough = F.col("text").rlike(r"\A(?:[ \t\r\n\x{FEFF}]*+[^ \t\r\n\x{FEFF}][^ \t\r\n]*+){%d}" % min_words)
    ids = rows.groupBy("id").agg(F.max(F.struct("key", enough.alias("long_enough"))).alias("t")).select("id", "t.*")
    return ids, rows.groupBy("key").agg(F.first("text").alias("text"))


def alike_pairs(texts: DataFrame, likeness: float = 0.7, words: int = 3, min_words: int = 20, n_tasks: int = 16) -> DataFrame:
    """(key_a, key_b, likeness) of different texts (key, text) that are alike, key_a < key_b."""

    def list_bits(batches):
        for block in H.in_blocks(batches, "text", BLOCK_CHARS):
            yield _list_bits(block, words, min_words)

    listed = texts.sortWithinPartitions("key").mapInArrow(list_bits, H.REQUEST_SCHEMA)
    bits = H.common_hashes(listed, n_tasks, with_hash=True).groupBy("block").applyInArrow(_shared_bits(likeness), BITS_SCHEMA)
    bits = materialize(bits, "alike-bits")
    of = lambda side: bits.select(*[F.col(c).alias(f"{c}_{side}") for c in bits.columns])
    pairs, met = candidates(bits, likeness)
    both = pairs.join(of("a"), "rid_a").join(of("b"), "rid_b")
    found = both.drop("rid_a", "rid_b").mapInArrow(_verify(likeness), "key_a binary, key_b binary, likeness double")
    # a record is told by the first half of its key up to here; which of two keys is the less is settled now
    found = found.filter("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "likeness")
    found = materialize(found.distinct(), "alike-pairs")
    discard(met)
    discard(bits)
    return found


def alike(df: DataFrame, id_col: str = "result_id", text_col: str = "text", likeness: float = 0.7, words: int = 3, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(id, key, long_enough) of every record, key naming its text, and the alike pairs of keys."""
    ids, texts = _texts(df, id_col, text_col, min_words)
    return ids, alike_pairs(texts, likeness, words, min_words, H.task_count(total_bytes(df, text_col)))


def expand(df: DataFrame, id_col: str = "result_id", text_col: str = "text", likeness: float = 0.7, words: int = 3, min_words: int = 20) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records that are alike, copies of one text too.

    Its size is that of the result asked for, at any number of copies; :func:`alike_groups`
    says the same in one row a record. The copies of a text are joined by salts.
    """
    ids, pairs = alike(df, id_col, text_col, likeness, words, min_words)
    told = ids.select("id", "key")
    between = pairs.join(told.select(F.col("key").alias("key_a"), F.col("id").alias("x")), "key_a").join(told.select(F.col("key").alias("key_b"), F.col("id").alias("y")), "key_b").select("x", "y")
    size = ids.filter("long_enough").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    mine = told.join(size.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "key")
    left = mine.select("key", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = mine.select("key", F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    copies = left.join(right, ["key", "salt"]).filter("x < y").select("x", "y")
    return between.unionByName(copies).select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


def alike_groups(df: DataFrame, id_col: str = "result_id", text_col: str = "text", likeness: float = 0.7, words: int = 3, min_words: int = 20) -> DataFrame:
    """(id, class_id, n_copies, n_links): one row per record that is alike to another.

    class_id is the smallest id of the group that links connect; n_copies counts the ids
    with the same text, n_links the different texts it is alike to.
    """
    ids, pairs = alike(df, id_col, text_col, likeness, words, min_words)
    links = pairs.select(F.col("key_a").alias("key"), F.col("key_b").alias("other"))
    links = materialize(links.unionByName(links.select(F.col("other").alias("key"), F.col("key").alias("other"))), "alike-links")
    discard(pairs)
    per_key = ids.filter("long_enough").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))
    label = materialize(per_key.join(links.groupBy("key").agg(F.count("*").alias("n_links")), "key", "left").select("key", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first_id").alias("class_id")).filter("n_links > 0 or n_copies > 1"), "alike-label")
    moved = True
    while moved:
        # the least label of a record and its neighbours, then the label's own label: paths halve each round
        near = links.join(label.select(F.col("key").alias("other"), F.col("class_id").alias("c")), "other").groupBy("key").agg(F.min("c").alias("c"))
        new = label.join(near, "key", "left").select("key", "n_copies", "n_links", F.least("class_id", F.coalesce("c", "class_id")).alias("class_id"), F.col("class_id").alias("was"))
        new = materialize(new, "alike-label")
        jump = new.filter("class_id <> was").groupBy(F.col("was").alias("class_id")).agg(F.min("class_id").alias("to"))
        after = materialize(new.join(jump, "class_id", "left").select("key", "n_copies", "n_links", F.coalesce("to", "class_id").alias("class_id")), "alike-label")
        moved = not jump.isEmpty()
        discard(label)
        discard(new)
        label = after
    discard(links)
    return ids.select("id", "key").join(label, "key").select(F.col("id").alias(id_col), "class_id", "n_copies", "n_links")
