"""Position hashes of many texts at once, and the exchange that finds hashes standing in several blocks.

Texts of a block are laid end to end as code points. ``P[i]`` is the prefix sum of
``mix(c[j]) * B**j`` modulo 2**64, so the hash of any window is one subtraction and
one multiplication by ``B**-start``: all windows of a block are hashed without a loop.
Offsets are code points everywhere.

``common_hashes`` answers, for hashes listed by many blocks, which stand in two
blocks or more. A block lists a hash once or twice however often it holds it, so a
hash that a third of all rows hold costs two entries a block, in one task as well as
on the wire. A block sends one row for each of 1,024 ranges of hashes at most, so rows
follow the data; where more tasks than ranges are needed, the pieces of a range are
gathered into larger blocks first and these are compared by the ranges within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.arrow import pack, unpack
from lakeweave.sources.tables import materialize

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """B**i and B**-i for i up to n, and the mixed code points; kept for the worker's next batch."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _POWERS[name] = p
        _POWERS.setdefault("chars", mix(np.arange(1 << 16, dtype=np.uint64)))
    return _POWERS["up"], _POWERS["down"], _POWERS["chars"]


class Block:
    """Texts end to end: ``off[d]`` is where text d begins, ``doc``/``pos`` say where a character stands."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.len = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.off = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.len)])
        n = len(codes)
        up, self._down, chars = _powers(n + 1)
        high = codes >= 1 << 16
        values = chars[np.where(high, 0, codes)]
        if high.any():
            values[high] = mix(codes[high])
        values *= up[:n]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=self.prefix[1:])

    def windows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the windows [start, end) of the joined texts."""
        return mix((self.prefix[end] - self.prefix[start]) * self._down[start])


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the group number of each row, and where each group begins."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.cumsum(new) - 1, np.nonzero(new)[0]


def union_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a text as one, sorted by (doc, start)."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    # the furthest end so far inside a document: lift each document above the one before it
    lift = np.int64(end.max() + 1)
    far = np.maximum.accumulate(end + doc * lift)
    new = np.concatenate([[True], start[1:] + doc[1:] * lift > far[:-1]])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], far[last] - doc[first] * lift


def key_words(table: pa.Table) -> np.ndarray:
    """The 16-byte keys of a block's texts, as two words each."""
    return np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint64)


def block_number(table: pa.Table) -> int:
    """A block's number, from what is in it: a task that runs again gives the same."""
    keys = key_words(table)
    return int(mix(np.array([keys.sum() + np.uint64(len(keys))], np.uint64))[0] >> np.uint64(1))


# --- the exchange -----------------------------------------------------------------

#: A level of the exchange tells hashes apart by so many of their top bits.
FAN_BITS = 10
FAN = 1 << FAN_BITS
#: Bytes of text whose hashes one task compares.
TASK_BYTES = 32 << 20
REQUEST_SCHEMA = "dest long, block long, own boolean, payload binary"
ANSWER_SCHEMA = "block long, own boolean, payload binary"


def _gaps(sorted_places: np.ndarray) -> np.ndarray:
    """Sorted numbers as 16-bit gaps: 65535 goes on to the next, anything else ends a gap."""
    gaps = np.diff(sorted_places.astype(np.int64), prepend=0)
    whole = gaps // 65535
    out = np.full(int(whole.sum()) + len(gaps), 65535, np.uint16)
    out[np.cumsum(whole + 1) - 1] = gaps % 65535
    return out


def _ungaps(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps < 65535]


def distinct(hashes: np.ndarray, holder: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block lists of its entries: (unlisted, known, code), as sorted entry numbers.

    Entries whose hash has several holders in the block are known to be common, with code 2
    where extras differ; of these one is listed, or two where extras differ. All others are listed.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    order = np.argsort(hashes, kind="stable") if extra is None else np.lexsort((extra, hashes))
    group, first = groups(hashes[order])
    d = holder[order]
    several = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first))[group]
    differ = np.zeros(n, bool)
    if extra is not None:
        x = extra[order]
        differ = (np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first))[group]
    listed = ~several
    listed[first] = True
    last = np.concatenate([first[1:], [n]]) - 1
    listed[last] |= differ[last]
    known = order[several]
    by = np.argsort(known)
    return np.sort(order[~listed]), known[by], np.where(differ[several], 2, 1).astype(np.uint8)[by]


def listed_entries(n: int, unlisted: np.ndarray) -> np.ndarray:
    keep = np.ones(n, bool)
    keep[unlisted] = False
    return np.nonzero(keep)[0]


def requests(block: int, own: bytes, hashes: np.ndarray, extra: np.ndarray | None, level: int = 1) -> pa.RecordBatch:
    """Rows that carry a block's listed hashes, whole, to the tasks that compare them.

    A listed hash is named by its place in the block's list; ``extra`` has 32 bits. The row
    marked ``own`` is what the block needs to read the answers, and goes along.
    """
    shift = np.uint64(64 - FAN_BITS * level)
    dest = (hashes >> shift).astype(np.int64)
    o = np.argsort(dest, kind="stable")
    _, first = groups(dest[o])
    ends = [*first[1:], len(o)]
    dests, blobs = [int(mix(np.array([block], np.uint64))[0] >> shift)], [own]
    for a, e in zip(first, ends):
        at = o[a:e]
        low = np.ascontiguousarray(hashes[at]).view(np.uint8).reshape(-1, 8)[:, :7]  # the top byte is the destination's
        dests.append(int(dest[at[0]]))
        blobs.append(pack(_gaps(at), low.ravel(), np.zeros(0, np.uint32) if extra is None else extra[at].astype(np.uint32)))
    n = len(dests)
    return pa.RecordBatch.from_arrays(
        [pa.array(dests, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([i == 0 for i in range(n)]), pa.array(blobs, pa.binary())],
        names=["dest", "block", "own", "payload"],
    )


def _read_requests(batches: Iterator[pa.RecordBatch], level: int):
    """(own rows, block numbers, source of each entry, place, hash, extra) of a task's requests."""
    own, names, src, place, key, extra = [], [], [], [], [], []
    at: dict[int, int] = {}
    top = np.uint64(64 - FAN_BITS * level)
    for batch in batches:
        for dest, block, is_own, blob in zip(*(batch.column(c).to_pylist() for c in ("dest", "block", "own", "payload"))):
            if is_own:
                own.append((block, blob))
                continue
            gap, low, x = unpack(blob)
            p = _ungaps(gap)
            h = np.zeros((len(p), 8), np.uint8)
            h[:, :7] = low.reshape(-1, 7)
            place.append(p.astype(np.uint32))
            key.append(h.view(np.uint64).ravel() | (np.uint64(dest >> (FAN_BITS * level - 8)) << np.uint64(56)))
            extra.append(x)
            if block not in at:
                at[block] = len(names)
                names.append(block)
            src.append(np.full(len(p), at[block], np.int32))
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return own, names, cat(src, np.int32), cat(place, np.uint32), cat(key, np.uint64), cat(extra, np.uint32)


def _answer_batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "own", "payload"])


def _answers(names: list[int], src: np.ndarray, place: np.ndarray, code: np.ndarray, key: np.ndarray, with_hash: bool) -> list[tuple[int, bool, bytes]]:
    o = np.argsort(src, kind="stable")
    src, place, code, key = src[o], place[o], code[o], key[o]
    cut = np.searchsorted(src, np.arange(len(names) + 1))
    none = np.zeros(0, np.uint64)
    return [(names[i], False, pack(place[a:e], code[a:e].astype(np.uint8), key[a:e] if with_hash else none)) for i, (a, e) in enumerate(zip(cut[:-1], cut[1:])) if a < e]


def _compare(level: int, with_hash: bool):
    def run(batches):
        own, names, src, place, key, extra = _read_requests(batches, level)
        rows = [(b, True, p) for b, p in own]
        if len(key):
            _, known, code = distinct(key, src, extra if len(extra) else None)
            rows += _answers(names, src[known], place[known], code, key[known], with_hash)
        if rows:
            yield _answer_batch(rows)

    return run


def _gather(level: int):
    """A task's requests as one block of their own, whose entries are those of the blocks in it."""

    def run(batches):
        own, names, src, place, key, extra = _read_requests(batches, level)
        if own:
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int64()), pa.array([b for b, _ in own], pa.int64()), pa.array([True] * n), pa.array([p for _, p in own], pa.binary())], names=["dest", "block", "own", "payload"])
        if len(key):
            x = extra if len(extra) else None
            unlisted, known, code = distinct(key, src, x)
            listed = listed_entries(len(key), unlisted)
            number = int(mix(np.array([np.bitwise_xor.reduce(mix(key ^ place))], np.uint64))[0] >> np.uint64(1))
            mine = pack(np.array(names, np.int64), src, place, unlisted.astype(np.uint32), known.astype(np.uint32), code, key)
            yield requests(number, mine, key[listed], None if x is None else x[listed], level + 1)

    return run


def _split(with_hash: bool):
    """Answers of a gathered block as answers of the blocks in it."""

    def run(table: pa.Table) -> pa.Table:
        (names, src, place, unlisted, known, known_code, key), told, told_code, _ = read_answers(table)
        code = np.zeros(len(src), np.uint8)
        code[known] = known_code
        listed = listed_entries(len(src), unlisted)[told]
        np.maximum.at(code, listed, told_code.astype(np.uint8))
        # every entry of a hash takes the greatest code of it
        o = np.argsort(key, kind="stable")
        group, first = groups(key[o])
        code[o] = np.maximum.reduceat(code[o], first)[group]
        hit = code > 0
        return pa.Table.from_batches([_answer_batch(_answers(names.tolist(), src[hit], place[hit], code[hit], key[hit], with_hash))])

    return run


def common_hashes(listed: DataFrame, n_tasks: int, with_hash: bool = False) -> DataFrame:
    """(block, own, payload): per block its own row, and answers for hashes that stand in two blocks or more.

    An answer's code is 2 where the extras of its hash differ, else 1. ``n_tasks`` compare; beyond
    ``FAN`` of them the pieces of each range are gathered first. Neither changes an answer.
    """
    if n_tasks <= FAN:
        return listed.repartition(max(1, n_tasks), "dest").mapInArrow(_compare(1, with_hash), ANSWER_SCHEMA)
    parts = -(-n_tasks // FAN)
    gathered = listed.repartition(FAN * parts, "dest", F.pmod("block", F.lit(parts))).mapInArrow(_gather(1), REQUEST_SCHEMA)
    gathered = materialize(gathered, "exchange")
    mine = gathered.filter("dest = -1").select("block", "own", "payload")
    second = gathered.filter("dest >= 0").repartition(n_tasks, "dest").mapInArrow(_compare(2, with_hash), ANSWER_SCHEMA)
    return mine.unionByName(second.groupBy("block").applyInArrow(_split(with_hash), ANSWER_SCHEMA))


def read_answers(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of one block's rows: its own arrays, and the answered (place, code, hash), sorted by place."""
    own, told = [], [(np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint64))]
    for is_own, p in zip(table.column("own").to_pylist(), table.column("payload").to_pylist()):
        arrays = unpack(p)
        if is_own:
            own = arrays
        else:
            told.append(tuple(arrays))
    place, code, key = (np.concatenate(x) for x in zip(*told))
    o = np.argsort(place, kind="stable")
    return own, place[o].astype(np.int64), code[o], key[o] if len(key) else key


def in_blocks(batches: Iterator[pa.RecordBatch], text: str, chars: int) -> Iterator[pa.Table]:
    """The rows of a partition in blocks of about ``chars`` bytes of text, whatever the batches' sizes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = 0
        lengths = np.diff(np.frombuffer(batch.column(text).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(text).offset)) if pa.types.is_string(batch.column(text).type) else np.array([len(x.as_py() or "") for x in batch.column(text)])
        ends = np.cumsum(lengths)
        base = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, base + chars - size, "left")) + 1
            upto = min(max(upto, at + 1), batch.num_rows)
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto - 1] - base)
            base, at = int(ends[upto - 1]), upto
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def task_count(text_bytes: int) -> int:
    """How many tasks compare the hashes of so many bytes of text: they follow the data."""
    return max(16, -(-text_bytes // TASK_BYTES))
