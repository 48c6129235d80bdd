from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import text as X
from lakeweave.operators import documents as D
from lakeweave.functions.arrow import pack, unpack

EDGES = ["", "   ", "\n", "﻿", "\x00", "a", "x" * 20000, "a\rb\rc", "a\r\nb\nc\rd", "```\nopen", "﻿```\nx\n```", "p\n\np\n\np", "one  two   three  ", "a\n\n\n\nb\n", " lead", "fin.  \n\n"]


def estimate(t):
    u = t.strip()
    return max(1, round((len(t) / 4 + len(u.split()) / 0.75) / 2)) if u else 0


def normal(t):
    import re

    t = t.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    t = "\n".join(re.sub(r"[ \t\f\x0b]+$", "", x) for x in t.split("\n"))
    t = re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip("\n")


def test_token_estimate_and_normalize(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)] + [(99, None)], "i int, t string")
    got = {r.i: r for r in df.select("i", X.token_estimate(F.col("t")).alias("n"), X.normalized(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(EDGES):
        assert got[i].n == estimate(t), repr(t[:20])
        assert got[i].c == normal(t), repr(t[:20])
    assert got[99].n == 0 and got[99].c is None
    again = df.select(X.normalized(X.normalized(F.col("t"))).alias("a"), X.normalized(F.col("t")).alias("b")).filter("a <> b").count()
    assert again == 0


def test_small_functions(spark):
    df = spark.createDataFrame([("Sent from my iPhone",), ("page 3 of 10",), ("On Monday, X wrote:",), ("----",), ("---",), ("text",)], "t string")
    assert [r[0] for r in df.select(X.boilerplate_kind(F.col("t"))).collect()] == ["email_signature", "page_marker", "email_reply_header", "decorative_rule", None, None]
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(X.language_vote, "und nicht auch wenn a b c d e f g h") == "de"
    assert one(X.language_vote, "und nicht auch wenn") is None
    assert one(X.redacted, "see https://a.b/c?d and me@x.org, password: hunter2, 10.0.0.1 src/a/b.py") == "see <URL> and <EMAIL>, <TOKEN> <HOST> <PATH>"
    assert one(X.size_label, "x" * 1023) == "1023 B" and one(X.size_label, "x" * 2048) == "2.0 KB"
    assert one(lambda c: X.cut_at_word(c, 7), "one two three") == "one two" and one(lambda c: X.cut_at_word(c, 6), "one two") == "one"
    assert one(X.terms, "The Fan-belt and the fan-belt of 300 fans") == ["fan-belt", "300", "fans"]
    assert one(X.content_type, '{"a": 1') == "json" and one(X.content_type, "def f():\n    return 1") == "code" and one(X.content_type, "") == "prose"
    assert [one(lambda c: X.gap_bucket(c.cast("double")), v) for v in (None, "0", "300", "3600", "7200", "28800")] == ["unknown", "<5m", "5m-1h", "1h-2h", "2h-8h", ">8h"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 255), max_size=20), max_size=5))
def test_pack(arrays):
    import numpy as np

    given_ = [np.array(a, t) for a, t in zip(arrays, (np.uint8, np.int64, np.float64, np.uint32, np.int16))]
    back = unpack(pack(*given_))
    assert len(back) == len(given_) and all(a.dtype == b.dtype and (a == b).all() for a, b in zip(given_, back))


def test_cleaning_keeps_fences_and_tables(spark):
    fence = "```\nx  =  1\n\n\n\n----\nSent from my phone\nx  =  1\n```"
    table = "| a  |  b |\n|----|----|\n| 1  |  2 |"
    text = "﻿Hello   there  \r\n\r\n\r\n\r\nPage 3 of 9\n\n" + fence + "\n\nHello there\n\n" + table + "\n\n" + fence
    df = spark.createDataFrame([(1, text), (2, "Hello   there  \n\n\n\nPage 3 of 9\n\nHello there\n----"), (3, None), (4, "```\nopen  fence\n\n\n\nto the end")], "doc_id long, text string")
    got = {r.doc_id: r for r in D.clean(df).collect()}
    assert got[1].unique == "Hello there\n\n" + fence + "\n\n" + table and (got[1].n_paragraphs, got[1].n_unique) == (5, 3)
    assert got[2].unique == "Hello there" and (got[2].n_paragraphs, got[2].n_unique) == (2, 1)
    assert got[3].unique == "" and got[4].unique == "```\nopen  fence\n\n\n\nto the end"


def test_masking(spark):
    from lakeweave.operators import masking

    cases = {
        "see https://a.b/c?d=1 now": "see <URL> now",
        "mail --x.y+z@mail.example.org, a@b": "mail --<EMAIL>, <EMAIL>",
        "Authorization: Bearer abc.def": "<TOKEN>",
        "my_api_key=9, max_tokens: 40 left": "<TOKEN> max_tokens: 40 left",
        "the password is hunter2 ok": "the <TOKEN> ok",
        "token tomorrow, token t0morrow": "token tomorrow, <TOKEN>",
        "ghp_abcdefgh12 and AKIA0123456789ABCD": "<TOKEN> and <TOKEN>",
        "in src/a/b.py and /etc/x.d/ or ~/n or C:\\tmp\\q": "in <PATH> and <PATH> or <PATH> or <PATH>",
        "10.0.0.1 db.internal.net host:8080 fe80::1": "<HOST> <HOST> <HOST> <HOST>",
        'say "hello you" or `x`': "say <VALUE> or <VALUE>",
        "12-05-2024 and x123456789": "<NUMBER> and x<NUMBER>",
        "plain words stay, e.g. a/b or 3.5": "plain words stay, e.g. a/b or 3.5",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "text string")
    got = [r[0] for r in df.select(masking.redact("text")).collect()]
    assert got == [*cases.values(), None]
    long = spark.createDataFrame([("a.b-c/" * 20000,), ("a" * 31 + "." * 50000,), ("/a" * 50000,), ("x@" * 20000,)], "text string")
    assert long.select(masking.redact("text")).count() == 4 and len(long.select(masking.redact("text").alias("t")).collect()) == 4
    keep = spark.createDataFrame([("test_a_very_long_name_without_any_digit_in_it password=x1 at src/a.py",)], "text string")
    assert keep.select(masking.mask_secrets("text")).first()[0] == "test_a_very_long_name_without_any_digit_in_it <TOKEN> at src/a.py"
    marks = masking.redacted(spark.createDataFrame([("a@b.c, 10.0.0.1 <HOST>",)], "text string")).first().marks
    assert marks == {"EMAIL": 1, "HOST": 1}
