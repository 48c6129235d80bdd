import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeweave.llm import near_dup as N


def words(text):
    return [w for w in re.split("[ \t\r\n]+", text.replace("﻿", "")) if w]


def brute(rows, likeness=0.7):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None and len(words(t)) >= 20:
            w = words(t)
            sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= likeness * len(sets[a] | sets[b])}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "result_id long, text string, key string, cell string")


def make(rnd, n):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            w = words(rnd.choice(rows)[1])
            for _ in range(rnd.randrange(0, max(1, len(w) // 12))):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(2)] = [rnd.choice(vocabulary)] * rnd.randrange(2)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([19, 20, 22, 30, 60, 200]))]
        rows.append((i, rnd.choice([" ", "\n", "\t", " \r\n"]).join(w)))
    return rows


def test_pairs_and_groups_against_brute_force(spark):
    rows = make(random.Random(1), 250)
    rows += [rows[7], (900, rows[7][1]), (901, "﻿" + rows[7][1] + " "), (902, None), (903, ""), (None, rows[7][1]), (904, "same " * 30), (905, "same " * 40)]
    df = frame(spark, rows)
    want = brute(rows)
    got = [tuple(r) for r in N.expand(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    classes = {r.result_id: r.class_id for r in N.alike_groups(df).collect()}
    assert classes == {x: root(x) for x in parent}


def test_crowded_cells(spark):
    """Half of all records share a long boilerplate and differ elsewhere; some of them are alike."""
    rnd = random.Random(5)
    banner = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = [f"o{i}_{k}" for k in range(60)] if i % 4 else [f"o{i // 20}_{k}" for k in range(20)]
        rows.append((i, " ".join(banner + own)))
    assert {tuple(r) for r in N.expand(frame(spark, rows)).collect()} == brute(rows)
    assert rnd


def test_cells_are_split_alike(spark, monkeypatch):
    """Cells of more than a few members are salted: the same pairs come out."""
    monkeypatch.setattr(N, "HOT", 3)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(rnd.randrange(0, 9)):
            w[rnd.randrange(90)] = f"o{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert len(want) > 300
    assert {tuple(r) for r in N.expand(frame(spark, rows)).collect()} == want


def test_banner_of_three_thousand_records(spark):
    """A banner of three quarters of each record's words, and of one of nine tenths."""
    rnd = random.Random(6)
    banner = [f"b{i}" for i in range(75)]
    rows = [(i, " ".join(banner + [f"o{i}_{k}" for k in range(25)])) for i in range(3000)]
    close = [(5000 + i, " ".join(["c"] + [f"c{k}" for k in range(90)] + [f"p{i}_{k}" for k in range(7)])) for i in range(40)]
    got = {tuple(r) for r in N.expand(frame(spark, rows + close)).collect()}
    assert got == brute(close) and len(got) == 40 * 39 // 2
    assert rnd


def test_five_thousand_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(5000)] + [(9000, text + " more"), (9001, text + " more")]
    df = frame(spark, rows)
    assert N.expand(df).count() == 5002 * 5001 // 2
    assert {(r.class_id, r.n_copies, r.n_links) for r in N.alike_groups(df).collect()} == {(0, 5000, 1), (0, 2, 1)}


@pytest.mark.parametrize("size", [18, 19, 25, 31, 40, 60, 90, 200, 420])
def test_pairs_at_the_threshold_share_a_cell(size):
    """Recall of the grid alone, of pairs as unlike as the threshold allows, equal in size and one within the other."""
    rnd = np.random.default_rng(size)
    n_pairs, lost = 400, 0
    for inner in (False, True):
        both = -(-7 * 2 * size // 17) if not inner else size
        a_own = size - both
        b_own = int(both / 0.7 + 1e-9) - both - a_own
        doc, h, n = [], [], []
        for p in range(n_pairs):
            common, x, y = (rnd.integers(0, 2**64, k, np.uint64) for k in (both, a_own, b_own))
            for part in (x, y):
                h += [common, part]
                doc += [np.full(both, len(n)), np.full(len(part), len(n))]
                n.append(both + len(part))
        d, cell, flags = N.cells(np.concatenate(doc), np.concatenate(h), np.array(n), 0.7)
        for p in range(n_pairs):
            rows = [(d == 2 * p + k) for k in (0, 1)]
            x, y = ({(c, f) for c, f in zip(cell[r].tolist(), flags[r].tolist())} for r in rows)
            lost += not any(c == e and not f & g & (N.BELOW | N.LESS) for c, f in x for e, g in y)
    assert lost == 0


def test_empty_table(spark):
    assert N.expand(frame(spark, [])).count() == 0
    assert N.alike_groups(frame(spark, [])).count() == 0


bits = st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True)


@settings(max_examples=60, deadline=None)
@given(bits, bits)
def test_distance_is_a_lower_bound(a, b):
    pop = [N.popcounts(np.zeros(len(x), np.int64), np.array(x, np.uint64), 1)[0].astype(int) for x in (a, b)]
    assert np.abs(pop[0] - pop[1]).sum() <= len(set(a) ^ set(b))


def test_shingles_are_those_of_the_words():
    texts = ["a b c d", "", " a\tb\r\nc d ", "﻿a b c d e", "x"]
    doc, h = N.shingles(texts, 3, 3)
    by = [set(h[doc == i].tolist()) for i in range(len(texts))]
    assert by[0] == by[2] and len(by[0]) == 2 and by[0] < by[3] and not by[1] and not by[4]
    assert not len(N.shingles(["a b c"], 3, 20)[0]) and not len(N.shingles([], 3, 20)[0])
