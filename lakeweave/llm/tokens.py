"""Token counts of an existing tokenizer, by segment.

A sentence-piece vocabulary is read from its file. A text is cut where no piece can
reach across: before a run of spaces, around a line feed, around a digit where the
vocabulary has digits alone only. What lies between is a *normalized segment*; each
distinct segment is counted once a worker and looked up afterwards, so the cost follows
the distinct segments.

Two counts come out for each text:

``viterbi``  the number of pieces on the best path of a unigram model, by count-only
             Viterbi over a double-array trie: for each position the best score and
             the number of pieces so far are kept, no path. For a unigram vocabulary
             this is the tokenizer's own count.
``tokens``   the tokenizer's own count. For vocabularies with merges (BPE), whose
             segmentation is no best path, it is the library's on each segment.

Defined results: a null or empty text has 0 tokens; characters without a piece count as
their UTF-8 bytes where the vocabulary has byte pieces, else as one unknown.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakeweave.sources.tables import spread

#: The public vocabulary counted with unless another path is given.
DEFAULT_MODEL = "piece_bpe_32k.model"
_SPACE = "▁"
_CACHE_LIMIT = 800_000


def default_model() -> str:
    """Path of the default vocabulary file, from the folder of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


class DoubleArray:
    """A double-array trie: the child of node s by code c is ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, pieces: list[str]):
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        width = len(self.codes) + 2
        size = 4 * sum(map(len, pieces)) + 2 * width
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        order = sorted((tuple(self.codes[c] for c in p), i) for i, p in enumerate(pieces) if p)
        check[0] = 0
        free = np.ones(size, bool)
        free[0] = False
        low = 1
        queue = [(0, 0, len(order), 0)]  # node, rows [a, b) of the sorted pieces, depth
        while queue:
            node, a, b, depth = queue.pop()
            children: list[tuple[int, int, int]] = []
            i = a
            while i < b:
                word = order[i][0]
                if len(word) == depth:
                    value[node] = order[i][1]
                    i += 1
                    continue
                c, j = word[depth], i
                while j < b and len(order[j][0]) > depth and order[j][0][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            if not children:
                continue
            cs = np.array([c for c, _, _ in children])
            while not free[low]:
                low += 1
            at, look = -1, low
            while at < 0:
                # the first place where all children are free, among the free slots of a stretch
                if look + 4 * width >= size:
                    base, check = np.concatenate([base, np.zeros(size, np.int64)]), np.concatenate([check, np.full(size, -1, np.int64)])
                    value, free = np.concatenate([value, np.full(size, -1, np.int64)]), np.concatenate([free, np.ones(size, bool)])
                    size *= 2
                slot = np.nonzero(free[look : look + width])[0] + look - cs[0]
                slot = slot[slot > 0]
                ok = free[slot[:, None] + cs].all(1) if len(slot) * len(cs) < 1 << 22 else np.array([free[x + cs].all() for x in slot])
                at = int(slot[ok.argmax()]) if ok.any() else -1
                look += width
            base[node] = at
            check[at + cs] = node
            free[at + cs] = False
            queue += [(at + c, i, j, depth + 1) for c, i, j in children]
        top = int(np.nonzero(~free)[0].max()) + width + 1
        self.base, self.check, self.value = (np.resize(x, top) if len(x) < top else x[:top] for x in (base, check, value))
        self.longest = max(map(len, pieces), default=0)
        # the code of each character; the last place stands for all that are in no piece
        self.table = np.zeros(max(map(ord, self.codes), default=0) + 2, np.int64)
        for c, i in self.codes.items():
            self.table[ord(c)] = i

    def encode(self, text: str) -> list[int]:
        """The codes of a text; 0 is a character in no piece."""
        return [self.codes.get(c, 0) for c in text]

    def get(self, text: str) -> int:
        """The number of a piece, or -1."""
        node = 0
        for c in self.encode(text):
            to = self.base[node] + c
            if not c or self.check[to] != node:
                return -1
            node = to
        return int(self.value[node])


#: Characters of segments that are searched at once.
AT_ONCE = 400_000


def count_best_path(trie: DoubleArray, score: np.ndarray, segments: list[str], byte_fallback: bool) -> np.ndarray:
    """Pieces on the best path of each segment: Viterbi over all segments at once, counts only."""
    out = np.zeros(len(segments), np.int64)
    ends = np.cumsum([len(s) for s in segments]) if segments else np.zeros(0, np.int64)
    at = 0
    while at < len(segments):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        out[at:upto] = _count_some(trie, score, segments[at:upto], byte_fallback)
        at = upto
    return out


def _count_some(trie: DoubleArray, score: np.ndarray, segments: list[str], byte_fallback: bool) -> np.ndarray:
    lengths = np.array([len(s) for s in segments], np.int64)
    begin = np.cumsum(lengths) - lengths
    chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
    code = trie.table[np.minimum(chars, len(trie.table) - 1)]
    owner = np.repeat(np.arange(len(segments)), lengths)
    end = (begin + lengths)[owner]
    # every piece that begins at any character: all of them go down the trie together
    live, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
    starts, sizes, scores = [], [], []
    for depth in range(trie.longest):
        fits = live + depth < end[live]
        live, node = live[fits], node[fits]
        if not len(live):
            break
        c = code[live + depth]
        to = trie.base[node] + c
        ok = (c > 0) & (trie.check[to] == node)
        live, node = live[ok], to[ok]
        piece = trie.value[node]
        whole = piece >= 0
        starts.append(live[whole])
        sizes.append(np.full(int(whole.sum()), depth + 1))
        scores.append(score[piece[whole]])
    starts, sizes, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, scores))
    # a character may stand for itself, as an unknown
    cost = np.ones(len(chars), np.int64)
    if byte_fallback:
        cost = np.where(code == 0, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 1)
    alone = (float(score.min()) - 10.0) * cost
    # a segment has a place more than it has characters; places are worked off from the left, in all segments at once
    slot = np.arange(len(chars)) + owner
    best = np.full(len(chars) + len(segments), -np.inf)
    count = np.zeros(len(best), np.int64)
    first = begin + np.arange(len(segments))
    best[first] = 0.0
    left = np.arange(len(chars)) - begin[owner]
    left = left.astype(np.uint16) if lengths.max(initial=0) < 1 << 16 else left  # small numbers sort faster
    by_char = np.argsort(left, kind="stable")
    char_cut = np.searchsorted(left[by_char], np.arange(int(lengths.max(initial=0)) + 1))
    by_piece = np.argsort(left[starts], kind="stable")
    piece_cut = np.searchsorted(left[starts[by_piece]], np.arange(len(char_cut)))
    source, target, gain = slot[starts[by_piece]], (slot[starts] + sizes)[by_piece], scores[by_piece]
    for i in range(len(char_cut) - 1):
        x = by_char[char_cut[i] : char_cut[i + 1]]
        s, value = slot[x], best[slot[x]] + alone[x]
        better = value > best[s + 1]
        s, x = s[better], x[better]
        best[s + 1], count[s + 1] = value[better], count[s] + cost[x]
        p = slice(piece_cut[i], piece_cut[i + 1])
        value = best[source[p]] + gain[p]
        better = value > best[target[p]]
        to = target[p][better]
        best[to], count[to] = value[better], count[source[p][better]] + 1
    return count[first + lengths]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[DoubleArray, np.ndarray, bool, bool]:
    """(trie, score of each piece, whether it has byte pieces, whether it is a unigram vocabulary) of the file at ``path``.

    Merge vocabularies hold ranks in place of log probabilities: a piece's score is then its
    rank's share under Zipf's law.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = _plain_ids(model)
    scores = np.array([model.get_score(i) for i in ids])
    is_unigram = bool((scores != np.floor(scores)).any())
    if not is_unigram:
        rank = np.arange(len(ids)) + 2.7
        scores = -np.log(rank) - math.log(float((1 / rank).sum()))
    return DoubleArray([model.id_to_piece(i) for i in ids]), scores, any(model.is_byte(i) for i in range(model.get_piece_size())), is_unigram


def _plain_ids(model) -> list[int]:
    return [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Counts tokens with the vocabulary file at ``path``; one is kept a worker.

    ``words`` is what :func:`vocabulary` gives, or None where best paths are not asked for.
    """

    def __init__(self, path: str, words: tuple[DoubleArray, np.ndarray, bool, bool] | None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in _plain_ids(self.model)]
        self.words = words
        self.digits_alone = not any(len(p.lstrip(_SPACE)) > 1 and re.search("[0-9]", p) or re.fullmatch(f"{_SPACE}+[0-9]", p) for p in pieces)
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            raise ValueError("this vocabulary has pieces that reach across spaces or lines")
        self.cut = re.compile(r" *[^ \n0-9]+| +|[0-9]|\n" if self.digits_alone else r" *[^ \n]+| +|\n")
        self.known: dict[str, int] = {}
        self.shift = 1 << 40

    def _learn(self, new: list[str]) -> None:
        paths = np.zeros(len(new), np.int64)
        unigram = False
        if self.words:
            trie, score, byte_fallback, unigram = self.words
            paths = count_best_path(trie, score, [s.replace(" ", _SPACE) for s in new], byte_fallback)
        own = paths if unigram else self._merged(new)
        self.known.update(zip(new, (np.asarray(own) * self.shift + paths).tolist()))

    def _merged(self, segments: list[str]) -> np.ndarray:
        """The library's count of each segment. It puts a space before a text, so each goes behind a
        line feed, which no piece reaches across."""
        lead = len(self.model.encode("\n"))
        return np.array([len(x) - lead for x in self.model.encode(["\n" + s for s in segments], num_threads=1)])

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, viterbi) of each text; equal texts of a call are counted once."""
        index: dict[str, int] = {}
        which = [index.setdefault(t, len(index)) if t else -1 for t in texts]
        # the mark for a space counts as one where a text has it
        pieces = [self.cut.findall(" " + (t.replace(_SPACE, " ") if _SPACE in t else t)) for t in index]
        out = np.zeros(len(pieces) + 1, np.int64)
        at, held = 0, 0
        fresh: set[str] = set()
        for i, p in enumerate(pieces):
            fresh.update(p)
            held += len(p)
            if held > 400_000 or i == len(pieces) - 1:
                new = [s for s in fresh if s not in self.known]
                if new:
                    if len(self.known) + len(new) > _CACHE_LIMIT:
                        self.known.clear()
                        new = list(fresh)
                    self._learn(new)
                get = self.known.__getitem__
                for j in range(at, i + 1):
                    out[j] = sum(map(get, pieces[j]))
                    pieces[j] = []
                at, held = i + 1, 0
                fresh = set()
        out = out[which]
        return out // self.shift, out % self.shift


_KEPT: dict[tuple[str, bool], Counter] = {}


def counter(path: str, words: tuple[DoubleArray, np.ndarray, bool, bool] | None) -> Counter:
    """This worker's counter for the file."""
    key = (path, words is not None)
    if key not in _KEPT:
        _KEPT[key] = Counter(path, words)
    return _KEPT[key]


def with_tokens(df: DataFrame, text_col: str = "text", model: str | None = None, keep_text: bool = False, paths: bool = True) -> DataFrame:
    """The rows with ``tokens``, ``viterbi_tokens`` and ``n_chars``; the text itself is left behind unless kept.

    Without ``paths`` no best paths are counted for a vocabulary of merges, and ``viterbi_tokens`` is 0.
    The trie has the vocabulary's size: the driver makes it once and sends it to every task.
    """
    path = model or default_model()
    words = vocabulary(path) if paths or _is_unigram(path) else None
    shared = df.sparkSession.sparkContext.broadcast(words) if words else None
    fields = [f for f in df.schema.fields if keep_text or f.name != text_col]
    clash = {"tokens", "viterbi_tokens", "n_chars"} & {f.name for f in fields}
    fields = [f for f in fields if f.name not in clash]
    schema = T.StructType([*fields, T.StructField("tokens", T.LongType()), T.StructField("viterbi_tokens", T.LongType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        c = counter(path, shared.value if shared else None)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            tokens, best = c.count(texts)
            chars = np.array([len(t) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(tokens), pa.array(best), pa.array(chars)], names=schema.fieldNames())

    return spread(df).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _is_unigram(path: str) -> bool:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return any(x != math.floor(x) for x in (model.get_score(i) for i in _plain_ids(model)))
