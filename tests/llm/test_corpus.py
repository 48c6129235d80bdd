import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.llm import mixture, packing, token_budget
from lakeweave.llm import tokens as K

TEXTS = ["", " ", "a", "hello  world\n\nnext\tline", "  lead and trail  ", "x1y22 333 ▁ é ﬁ 漢字 😀 \x00 \r\n", "word " * 500, "ZZZZqqqq" * 300, "\n \n  \n"]


@pytest.fixture(scope="module")
def counter():
    return K.counter(K.default_model(), K.vocabulary(K.default_model()))


def test_counts_are_the_tokenizers(counter):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("ab 0\n.,▁éñ漢😀-_") for _ in range(rnd.randrange(200))) for _ in range(300)]
    tokens, paths = counter.count(texts)
    assert tokens.tolist() == [len(x) for x in counter.model.encode(texts)]
    assert (paths >= 0).all() and paths[0] == 0


def test_trie_finds_its_pieces_and_no_other():
    pieces = ["a", "ab", "abc", "b", "bca", "漢", "zzzz"]
    trie = K.DoubleArray(pieces)
    every = {"".join(p) for n in range(1, 5) for p in itertools.product("abcz漢", repeat=n)}
    assert {p for p in every if trie.get(p) >= 0} == set(pieces)
    assert [trie.get(p) for p in pieces] == list(range(len(pieces)))


def best_path(pieces, scores, text, unknown):
    best = [(0.0, 0)] + [(-1e18, 0)] * len(text)
    for i in range(len(text)):
        for p, s in [*zip(pieces, scores), (text[i], unknown)]:
            if text.startswith(p, i) and best[i][0] + s > best[i + len(p)][0] + 1e-12:
                best[i + len(p)] = (best[i][0] + s, best[i][1] + 1)
    return best[-1][1]


def test_viterbi_counts_equal_the_unigram_library():
    """The vocabulary is written down, not trained; the library's own unigram model is the reference."""
    from tokenizers import Tokenizer, models

    rnd = random.Random(4)
    pieces = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))) for _ in range(60)} | {"a", "b", "c"})
    scores = [-rnd.random() * 10 - 1 for _ in pieces]
    library = Tokenizer(models.Unigram([("<unk>", -50.0), *zip(pieces, scores)], unk_id=0))
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 40))) for _ in range(200)]
    got = K.count_best_path(K.DoubleArray(pieces), np.array(scores), texts, False)
    assert got.tolist() == [len(library.encode(t).tokens) for t in texts]
    odd = ["axbz", "zz", ""]
    assert K.count_best_path(K.DoubleArray(pieces), np.array(scores), odd, False).tolist() == [best_path(pieces, scores, t, min(scores) - 10) for t in odd]


def test_budget_and_sessions(spark):
    results = spark.createDataFrame(
        [(1, "s", "p", "c1", "one two"), (1, "s", "p", "c1", "one two"), (2, "s", None, "c1", None), (3, "t", "q", None, "three"), (None, "t", "q", None, "lost")],
        "result_id long, session_id string, project_id string, call_id string, text string",
    )
    calls = spark.createDataFrame([("s", 1, 0, "c1", " mcp__box__Read "), ("s", 1, 0, "c1", " mcp__box__Read "), ("s", 3, 0, "c1", "Bash"), ("t", 1, 0, None, "Bash")], "session_id string, message_index int, pos int, call_id string, tool string")
    sessions = spark.createDataFrame([("s", "p", "en-GB"), ("t", None, None)], "session_id string, project_id string, lang string")
    projects = spark.createDataFrame([("p", "pay"), ("q", None)], "project_id string, domain string")
    docs = spark.createDataFrame([(1, "DE", " Forum ", "ein Text"), (2, "und", None, ""), (1, "DE", " Forum ", "ein Text")], "doc_id long, lang string, source string, text string")
    sources = spark.createDataFrame([("forum", "talk")], "source string, domain string")
    got = {(r.corpus, r.part, r.lang, r.domain): (r.n_records, r.tokens, r.n_chars) for r in token_budget.budget(results, calls, sessions, projects, docs, sources).collect()}
    n = lambda t: int(K.counter(K.default_model(), K.vocabulary(K.default_model())).count([t])[0][0])
    assert got == {
        ("results", "read", "en", "pay"): (2, n("one two"), 7),
        ("results", "unknown", "und", "unknown"): (1, n("three"), 5),
        ("documents", "forum", "de", "talk"): (1, n("ein Text"), 8),
        ("documents", "unknown", "und", "unknown"): (1, 0, 0),
    }
    messages = spark.createDataFrame([("s", 0, "hi"), ("s", 0, "hi"), ("u", 0, None)], "session_id string, message_index int, text string")
    reports = spark.createDataFrame([(7, "s", 10.0), (7, "s", 10.0), (8, "s", None), (9, "v", 0.0)], "report_id long, session_id string, tokens_before double")
    rows = {(r.session_id, r.report_id): (r.result_tokens, r.message_tokens, r.ratio) for r in token_budget.session_totals(results, messages, reports).collect()}
    assert rows[("s", 7)] == (n("one two"), n("hi"), round((n("one two") + n("hi")) / 10, 4)) and rows[("s", 8)][2] is None
    assert rows[("v", 9)] == (0, 0, None) and rows[("u", None)][:2] == (0, 0)
    empty = token_budget.budget(*(x.limit(0) for x in (results, calls, sessions, projects, docs, sources)))
    assert empty.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fill_is_the_best_subset(counts, room):
    got = packing.fill(dict(counts), room)
    assert all(0 < n <= counts[x] for x, n in got.items())
    sums = {0}
    for x, n in counts.items():
        sums |= {s + x * k for s in sums for k in range(1, n + 1)}
    assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_pack_items(spark):
    rnd = random.Random(2)
    items = [(i, rnd.choice([0, 1, 3, 17, 40, 99, 100, 101, 250, 300])) for i in range(700)] + [(5000, None)]
    items += [items[3], items[4]] + [(9000 + i, 40) for i in range(900)]  # a third of all items have one length
    df = spark.createDataFrame([(*x, 1) for x in items], "id long, tokens long, bucket int")
    rows = packing.pack_items(df, 100, "c").collect()
    size, pieces = {}, {}
    for r in rows:
        size[r.bin_id] = size.get(r.bin_id, 0) + r.tokens
        pieces.setdefault(r.id, []).append((r.piece, r.tokens, r.n_pieces))
    assert max(size.values()) <= 100
    want = {i: n for i, n in items if n}
    assert set(pieces) == set(want)
    for i, p in pieces.items():
        assert sum(t for _, t, _ in p) == want[i] and len(p) == p[0][2] == -(-want[i] // 100)
        assert sorted(x for x, _, _ in p) == list(range(len(p)))
    fit = []  # first fit decreasing
    for t in sorted((r.tokens for r in rows), reverse=True):
        at = next((k for k, room in enumerate(fit) if room >= t), None)
        if at is None:
            fit.append(100 - t)
        else:
            fit[at] -= t
    assert len(size) <= len(fit)
    assert sorted(size) == list(range(len(size)))
    s = packing.slack(packing.pack_items(df, 100, "c")).first()
    assert s.n_bins == len(size) and s.tokens == sum(want.values()) and s.unused == 100 * len(size) - sum(want.values())
    assert packing.pack_items(df.limit(0), 100).count() == 0


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["A ", "a", "b", "C", "none", None]), rnd.randrange(0, 50)) for i in range(3000)] + [(9999, "a", None), (1, "a", 3), (1, "a", 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, source string, tokens long, key string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 4), ("c", 0.3, 2), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    selection, report = mixture.mix(df, targets)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"a", "b", "c", "gone"}
    for s, w in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        assert abs(rep[s].reached_share - w) < 0.002 and rep[s].most_used <= rep[s].max_repeats
        assert abs(rep[s].used_tokens - rep[s].budget) <= 25
    # one source is used up to its cap: the total could not be larger
    assert any(rep[s].budget >= rep[s].size * rep[s].max_repeats - 1 for s in "abc")
    used = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times_used")).alias("n"), F.count("*").alias("k"), F.count_distinct("id").alias("d")).collect()
    assert {r.source: r.n for r in used} == {s: rep[s].used_tokens for s in "abc"} and all(r.k == r.d for r in used)
    again = {tuple(r) for r in mixture.mix(df.repartition(7), targets)[0].collect()}
    assert again == {tuple(r) for r in selection.collect()}
    selection, report = mixture.mix(df.limit(0), targets)
    assert selection.count() == 0 and all(r.used_tokens == 0 for r in report.collect())
    assert json.dumps(sorted(rep)) == '["a", "b", "c", "gone"]'
