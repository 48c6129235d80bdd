import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.llm import pii

GIVEN = ["Clara", "Emil", "Noémie", "Tomás"]
FAMILIES = ["Harbeck", "Harstone", "Millbeck", "Millstone", "Dunbeck", "Dunstone"]
TRAIN = [f"Hello all, my name is {g} {f} and this pump is new." for g in ("Clara", "Emil", "Odette", "Ruben") for f in FAMILIES]
TRAIN += [f"the pump was good\nBest regards, Dr. {f}" for f in FAMILIES] + [f"Ask {f}, {g} about the old boiler, it works well" for g in GIVEN for f in FAMILIES]
TRAIN += ["I live at 3 Old Mill Street, Westhaven 01234.", "Send it to 9 Mill Road, Westhaven.", "the boiler room needs a new seal and the Rose Garden pump was wet"] * 3


@pytest.fixture(scope="module")
def model():
    return pii.fit(TRAIN, GIVEN)


def kinds(text, model):
    return [(k, text[s:e]) for k, s, e in pii.finds(text, model)]


CASES = [
    ("mail me: a.b+c@mail.example.org.", [("email", "a.b+c@mail.example.org")]),
    ("write to joe [at] mail [dot] example [dot] net, or x_1 (at) a.test!", [("email", "joe [at] mail [dot] example [dot] net"), ("email", "x_1 (at) a.test")]),
    ("joe&#64;mail.test and JOE @ MAIL.TEST", [("email", "joe&#64;mail.test"), ("email", "JOE @ MAIL.TEST")]),
    ("install pkg@1.2.3, ssh me@localhost, run x@v16 now, thanks @joe", []),
    ("Call +44 7700 900123 after six or (030) 23125-608.", [("phone", "+44 7700 900123"), ("phone", "(030) 23125-608")]),
    ("tél. 01 99 00 12 34 / Text me: 503-555-0101", [("phone", "01 99 00 12 34"), ("phone", "503-555-0101")]),
    ("order 4471-220-938, EAN 4088155096256, article 916-21-0995, build 2025.03.25, 2025-02-17 10:17 UTC, part number 865-20-2015475", []),
    ("social security no 941-49-6657 was printed, passport number is XZ0 123 456, why", [("id_number", "941-49-6657"), ("id_number", "XZ0 123 456")]),
    ("National insurance: qq 12 34 56 c\nSteuer-ID 12 345 678 901", [("id_number", "qq 12 34 56 c"), ("id_number", "12 345 678 901")]),
    ("I live at 87 Copper Beck Drive, Flat 2b, Westhaven 00623, come by", [("address", "87 Copper Beck Drive, Flat 2b, Westhaven 00623")]),
    ("Send it to 5 Old Mill St.. Then wait", [("address", "5 Old Mill St.")]),
    ("Ich wohne Lindenstraße 12a, 00593 Oberfelden. Die Straße 120 ist neu", [("address", "Lindenstraße 12a, 00593 Oberfelden")]),
    ("au 20 bis rue des Trois Ormes\n00427 Brasselieu", [("address", "20 bis rue des Trois Ormes\n00427 Brasselieu")]),
    ("Calle del Molino, 20, 3º B. Y luego", [("address", "Calle del Molino, 20, 3º B")]),
    ("we have 24 street lamps here", []),
    ("Thanks to Clara Harbeck for it", [("person", "Clara Harbeck")]),
    ("MILLSTONE, EMIL and emil dunbeck and Ruben T. Harstone", [("person", "MILLSTONE, EMIL"), ("person", "emil dunbeck"), ("person", "Ruben T. Harstone")]),
    ("Ask Mrs. Dunstone about it, or Clara&nbsp;Harbeck", [("person", "Dunstone"), ("person", "Clara&nbsp;Harbeck")]),
    ("the Harbeck method, thanks Clara! the Rose Garden pump", []),
    ("", []), (None, []), ("   \n", []), ("@" * 3000, []), ("+" * 200 + "1" * 400, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_finds(model, text, want):
    assert kinds(text, model) == want


def test_skip_edges_carry_a_label(model):
    """A number that nothing names is a phone because the same number is named elsewhere."""
    alone = "in the list 900 123 456 stood"
    assert kinds(alone, model) == []
    assert kinds("Call 900 123 456 please. " + "x " * 500 + alone, model).count(("phone", "900 123 456")) == 2


def test_messages_equal_exact_marginals_on_a_tree():
    rnd = np.random.default_rng(1)
    pot = [rnd.normal(size=k) for k in (2, 3, 2, 3)]
    edges = [(0, 1, rnd.normal(size=(2, 3))), (1, 2, rnd.normal(size=(3, 2))), (1, 3, rnd.normal(size=(3, 3)))]
    joint = np.zeros((2, 3, 2, 3))
    for a in np.ndindex(joint.shape):
        joint[a] = np.exp(sum(p[i] for p, i in zip(pot, a)) + sum(t[a[i], a[j]] for i, j, t in edges))
    for n, b in enumerate(pii.propagate(pot, edges, rounds=60)):
        p = np.exp(b - b.max())
        want = joint.sum(axis=tuple(i for i in range(4) if i != n))
        assert np.allclose(p / p.sum(), want / want.sum(), atol=1e-3)


def test_mask_keeps_the_rest(model):
    text = "Hi 😀 Clara Harbeck, mail x@y.test or call +44 7700 900123."
    assert pii.mask(text, pii.finds(text, model)) == "Hi 😀 [PERSON], mail [EMAIL] or call [PHONE]."
    assert pii.mask(None, []) is None


def test_operator(spark, model):
    df = spark.createDataFrame([(1, "mail x@y.test", "a"), (1, "mail x@y.test", "a"), (2, None, "b"), (3, "", "c"), (None, "x@y.test", "d"), (4, "long " * 20000 + "x@y.test", "e")], "doc_id long, text string, kind string")
    assert {tuple(r) for r in pii.find(df, model).collect()} == {(1, "email", 5, 13), (4, "email", 100000, 100008)}
    assert {(r.doc_id, r.n_finds) for r in pii.masked(df, model).collect()} == {(1, 1), (2, 0), (3, 0), (4, 1)}
    names = spark.createDataFrame([("Clara", "en"), (None, None)], "given_name string, lang string")
    fitted = pii.train(spark.createDataFrame(list(enumerate(TRAIN)), "doc_id long, text string"), names)
    assert kinds("Thanks to Clara Harbeck for it", fitted) == [("person", "Clara Harbeck")]
    nothing = pii.train(df.limit(0), names.limit(0))
    assert pii.find(df.limit(0), nothing).count() == 0 and kinds("x@y.test", nothing) == [("email", "x@y.test")]


def test_towns_are_counted_over_all_texts(spark):
    """A town is known from one text without an introduction, however long, and from what stands after a unit."""
    texts = ["hello " * 1000 + "Paseo del Olmo 133, Puebla del Sauce, pasad", "at 4 Copper Beck Drive, Flat 2b, Nether Ashby.", "at 7 Old Mill Street\nAda Verloren\n", "from 9 Mill Road, Puebla del Sauce The end", "from 9 Mill Road, Nether Ashby The end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([("Clara", "en")], "given_name string, lang string")
    want = [{"Paseo del Olmo 133, Puebla del Sauce"}, {"4 Copper Beck Drive, Flat 2b, Nether Ashby"}, {"7 Old Mill Street"}, {"9 Mill Road, Puebla del Sauce"}, {"9 Mill Road, Nether Ashby"}]
    held, joined = pii.train(df, names), pii.train(df, names, towns=1)
    assert held.towns == {"Puebla del Sauce", "Nether Ashby"} and not joined.towns and joined.town_table.count() == 2
    for model in (held, joined):
        got = [{texts[r.doc_id][r.span_start : r.span_end] for r in pii.find(df, model).filter(F.col("doc_id") == i).collect() if r.kind == "address"} for i in range(5)]
        assert got == want
    assert {(r.doc_id, r.text) for r in pii.masked(df, joined).collect()} == {(r.doc_id, r.text) for r in pii.masked(df, held).collect()}


def test_a_given_name_before_a_given_name_is_a_node():
    """The first of two given names belongs to the name although it is no likely family name."""

    class Fixed(pii.Model):
        def word(self, word):
            return {"Anna": (-4.0, 0.0, -8.0), "Maria": (-4.0, 0.0, -8.0), "Schmidt": (-4.0, -8.0, 0.0)}.get(word, (0.0, -8.0, -8.0))

    m = Fixed(np.zeros((1, 3)), frozenset(), frozenset())
    for name in ("Anna Maria Schmidt", "Maria Schmidt"):
        assert kinds(f"so {name} wrote it", m) == [("person", name)]
    assert kinds("so Anna Maria wrote it", m) == []


def test_a_copied_id_needs_no_label(model):
    text = "passport number is XZ0 123 456, why. " + "the pump " * 200 + "XZ0 123 456 and XZ0 123 457 in the list"
    assert kinds(text, model) == [("id_number", "XZ0 123 456")] * 2
    assert kinds("XZ0 123 456 in the list", model) == []


def test_overlapping_values_compete(model):
    """A stretch that looks like a phone and like a labelled identity number is one of them."""
    for text in ("call me, tax id 12 345 678 901",):
        assert len(kinds(text, model)) == 1


def test_weights_are_fitted():
    texts = TRAIN + [f"my name is Clara Harbeck, call 900 12{i} 456 or write\n900 12{i} 456\nthe list has 900 12{i} 456 too" for i in range(10)]
    model = pii.fit(texts[::-1], GIVEN)
    assert any(abs(a - b) > 1e-6 for a, b in zip(model.features, pii.FEATURES.values()))
    assert any(np.abs(model.tables[k] - v).max() > 1e-6 for k, v in pii.TABLES.items())
    again = pii.fit(texts[::-1], GIVEN)
    assert (again.features == model.features).all() and (again.weights == model.weights).all()


# phrases that stand in none of the project's tables
UNSEEN = [
    ("Reach our front desk under +32 470 12 34 56 at any hour", [("phone", "+32 470 12 34 56")]),
    ("fax me on (0221) 998877-0 before Friday", [("phone", "(0221) 998877-0")]),
    ("My passport, no. C4VK39F52, was stamped on 2023-11-08", [("id_number", "C4VK39F52")]),
    ("Parcel for 14 Quarry Lane, Westhaven please", [("address", "14 Quarry Lane, Westhaven")]),
    ("the invoice 2023-11-0815 lists 12 x 4,50 and 7 boxes of 300", []),
    ("chapters 3.1.4.1.5 to 9.2.6.5 of ISO 80000-2:2019", []),
    ("coordinates 50.9375 N, 6.9603 E, altitude 52 m, 10:45:30", []),
    ("kernel 6.8.0-45-generic with 32768 MB and checksum 9f86d081884c7d65", []),
    ("The Stone Age began 3 300 000 years ago near Lake Turkana", []),
    ("signed by Emil Millbeck on behalf of the board", [("person", "Emil Millbeck")]),
    ("first.last@sub.domain.example is read daily, support@ is not", [("email", "first.last@sub.domain.example")]),
    ("prices rose 12 345 678 901 times, said nobody", []),
]


def test_precision_and_recall_on_unseen_phrases(model):
    wrong = missed = right = 0
    for text, want in UNSEEN:
        got = kinds(text, model)
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert right >= 6 and right / (right + wrong) >= 0.85 and right / (right + missed) >= 0.85, (right, wrong, missed)
