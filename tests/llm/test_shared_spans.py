import random

import numpy as np
import pytest

from lakeweave.llm import hashing as H
from lakeweave.llm import shared_spans as S


def brute(rows, span):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = max(texts.get(i, ""), t)
    holders = {}
    for i, t in texts.items():
        for s in range(len(t) - span + 1):
            holders.setdefault(t[s : s + span], set()).add(i)
    out = set()
    for i, t in texts.items():
        shared = [False] * len(t)
        for s in range(len(t) - span + 1):
            if len(holders[t[s : s + span]]) > 1:
                shared[s : s + span] = [True] * span
        s = 0
        while s < len(t):
            e = s
            while e < len(t) and shared[e]:
                e += 1
            if e > s:
                out.add((i, s, e))
            s = e + 1
    return out


def run(spark, rows, span=200, extra=True):
    schema = "result_id long, text string" + (", key string, id int, n_chars int" if extra else "")
    df = spark.createDataFrame([(*r, "k", 1, 2) if extra else r for r in rows], schema)
    got = [(r.result_id, r.span_start, r.span_end) for r in S.shared_spans(df, span=span).collect()]
    assert len(got) == len(set(got))
    return set(got)


def word(rnd, n, letters="abcdefgh \n漢😀"):
    return "".join(rnd.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_random_edits_against_brute_force(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    base = [word(rnd, rnd.randrange(250, 1500)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            b = rnd.choice(base)
            n = rnd.choice([198, 199, 200, 201, 240, 290, 291, 400, len(b)])
            s = rnd.randrange(0, max(1, len(b) - n + 1))
            parts.append(b[s : s + n])
            parts.append(word(rnd, rnd.randrange(0, 120)))
        rows.append((i, "".join(parts)))
    rows += [rows[3], rows[4], (100, rows[5][1]), (101, None), (102, ""), (103, "x" * 199), (None, rows[0][1]), (104, "z" * 900), (105, "z" * 205)]
    want = brute(rows, 200)
    assert run(spark, rows) == want
    # small blocks, and ranges gathered before they are compared
    monkeypatch.setattr(S, "BLOCK_CHARS", 4000)
    assert run(spark, rows) == want
    monkeypatch.setattr(S.H, "FAN", 4)
    assert run(spark, rows) == want


def test_exact_length_and_self_repeats(spark):
    rnd = random.Random(9)
    a = word(rnd, 200, "abcdefghijkl")
    rows = [(1, "L" + a + "R"), (2, "M" + a + "S"), (3, a + a), (4, "q" * 500), (5, word(rnd, 300, "xyz"))]
    got = run(spark, rows, extra=False)
    assert got == brute(rows, 200) == {(1, 1, 201), (2, 1, 201), (3, 0, 400)}
    assert run(spark, [(1, a + a)]) == set()  # a text is no other text of its own


def test_banner_in_very_many_records(spark):
    rnd = random.Random(2)
    banner = word(rnd, 260)
    rows = [(i, word(rnd, rnd.randrange(60)) + banner + word(rnd, rnd.randrange(60))) for i in range(300)]
    assert run(spark, rows) == brute(rows, 200)


def test_other_span_and_empty_table(spark):
    rnd = random.Random(4)
    a = word(rnd, 400)
    rows = [(1, a[:150] + "#" + a[151:]), (2, a), (3, "!" + a[20:140])]
    assert run(spark, rows, span=110) == brute(rows, 110)
    assert run(spark, []) == set()
    with pytest.raises(ValueError):
        run(spark, rows, span=50)


def test_share(spark):
    df = spark.createDataFrame([(1, "ab" * 150), (2, "ab" * 150), (3, "c"), (4, None)], "result_id long, text string")
    got = {r.result_id: (r.n_chars, r.n_spans, r.shared_chars, r.shared_share) for r in S.shared_share(df).collect()}
    assert got == {1: (300, 1, 300, 1.0), 2: (300, 1, 300, 1.0), 3: (1, 0, 0, 0.0), 4: (0, 0, 0, None)}


def test_cover_has_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_gaps_round_trip():
    for places in ([], [0], [65534, 65535, 131070, 131071, 400000], list(range(5))):
        assert H._ungaps(H._gaps(np.array(places, np.int64))).tolist() == places
