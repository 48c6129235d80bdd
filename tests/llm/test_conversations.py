import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from lakeweave.llm import conversations as C

T = datetime(2025, 1, 1)
M = "session_id string, message_index int, role string, text string, sent_at timestamp, arrived_at timestamp, calls int"
K = "session_id string, message_index int, pos int, call_id string, tool string, input_json string"
R = "result_id long, session_id string, message_index int, pos int, call_id string, text string, is_error boolean"


def at(seconds):
    return T + timedelta(seconds=seconds)


def tables(spark, sessions, messages, calls, results):
    m = [(s, i, r, t, at(60 * (i or 0)) if x is None else x, None, 0) for s, i, r, t, x in messages]
    return (spark.createDataFrame([(s,) for s in sessions], "session_id string"), spark.createDataFrame(m, M), spark.createDataFrame(calls, K), spark.createDataFrame(results, R))


def test_reasons(spark):
    ok = [(0, "user", "q", None), (1, "assistant", "a", None)]
    messages = [(s, *x) for s in ("good", "twice", "unans", "orphan", "before", "nullid") for x in ok]
    messages += [("twice", 1, " Assistant ", "a", None)]
    messages += [("gap", 0, "user", "q", None), ("gap", 2, "assistant", "a", None), ("late", 1, "user", "q", None), ("late", 2, "assistant", "a", None)]
    messages += [("norole", 0, "user", "q", None), ("norole", 1, "  ", "x", None), ("norole", 2, "assistant", "a", None)]
    messages += [("conf", 0, "user", "q", None), ("conf", 1, "assistant", "a", None), ("conf", 1, "assistant", "b", None), ("nulltext", 0, "user", "q", None), ("nulltext", 1, "assistant", "a", None), ("nulltext", 2, "tool", None, None), ("nulltext", 2, "TOOL", "", None)]
    messages += [("noreply", 0, "user", "q", None), ("noreply", 1, "assistant", "a", None), ("noreply", 2, "user", "again", None), ("noreply", 3, "assistant", " \n", None)]
    messages += [("bycall", 0, "user", "q", None), ("bycall", 1, "assistant", None, None), ("blank", 0, "user", "\t \r\n", None), (None, 0, "user", "q", None)]
    calls = [("good", 1, 0, "c", "Read", "{}"), ("good", 1, 0, "c", "Read", "{}"), ("unans", 1, 0, "c", "x", None), ("before", 1, 0, "c", "x", None), ("bycall", 1, 0, "c", "x", None), ("acts", 1, 0, "c", "x", None), ("nullid", 1, 0, None, "x", None)]
    results = [(1, "good", 2, 0, "c", "r", None), (2, "orphan", 2, 0, "zz", "r", None), (3, "before", 1, 0, "c", "r", None), (4, "bycall", 2, 0, "c", "r", None), (5, "acts", 2, 0, "c", "r", None), (6, "orphan", 3, 0, None, None, None)]
    names = sorted({m[0] for m in messages if m[0]} | {"acts", "nothing"})
    got = {}
    for r in C.reasons(*tables(spark, [*names, "good", None], messages, calls, results)).collect():
        got.setdefault(r.session_id, []).append(r.reason)
    assert {k: sorted(v) for k, v in got.items()} == {
        "gap": ["gap"], "late": ["gap"], "norole": ["no_role"], "conf": ["conflict"], "unans": ["unanswered_call"], "nullid": ["unanswered_call"], "orphan": ["orphan_result"],
        "before": ["result_before_call"], "noreply": ["no_reply"], "blank": ["empty"], "nothing": ["empty"],
    }


def test_conversations_and_clocks(spark):
    """The user's clock is 100 s ahead: as sent, every answer is older than its question."""
    messages, t = [], 0
    for i in range(10):
        user = i % 2 == 0
        messages.append(("s", i, "User " if user else "assistant", f"m{i}", at(t + (100 if user else 0))))
        t += 20
    messages += [messages[4], ("one", 0, "user", "q", at(0)), ("one", 1, "assistant", "a", None)]
    calls = [("s", 1, 1, "b", "Bash", "{}"), ("s", 1, 0, "a", "Read", "{}"), ("s", 1, 0, "a", "Read", "{}")]
    results = [(1, "s", 2, 0, "a", "ra", False), (2, "s", 2, 1, "b", None, True), (2, "s", 2, 1, "b", None, True)]
    t4 = tables(spark, ["s", "one", "gone"], messages, calls, results)
    ev = C.events(*t4[1:])
    offsets = {(r.session_id, r.sender): r for r in C.clock_offsets(ev).collect()}
    assert abs(offsets[("s", "user")].offset_s - 100) < 1e-6 and abs(offsets[("s", "user")].delay_s - 20) < 1e-6 and offsets[("s", "assistant")].offset_s == 0
    assert offsets[("one", "user")].offset_s == 0  # one gap says nothing
    rows = C.conversations(*t4).collect()
    s = sorted((r for r in rows if r.session_id == "s"), key=lambda r: r.turn)
    assert [r.message_index for r in s] == list(range(10)) and [r.turn for r in s] == list(range(1, 11)) and {r.role for r in s} == {"user", "assistant"}
    assert not any(r.early for r in s) and s[3].corrected_at - s[2].corrected_at == timedelta(seconds=20)
    assert [tuple(r)[3:] for r in C.acts(*t4).orderBy("pos").collect()] == [("a", "Read", "{}", "ra", False), ("b", "Bash", "{}", None, True)]
    assert not [r for r in rows if r.session_id == "gone"]


def test_empty_tables(spark):
    t = tables(spark, [], [], [], [])
    assert C.reasons(*t).count() == 0 and C.conversations(*t).count() == 0


def test_clocks_decide_order_and_rejection(spark):
    """A reply without index, sent by a clock 1,000 s behind: as sent it lies before the question."""
    messages = [("s", i, "user" if i % 2 == 0 else "assistant", f"m{i}", at(20 * i + (1000 if i % 2 == 0 else 0))) for i in range(7)]
    lost = ("s", None, "assistant", "reply", at(20 * 7))
    t = tables(spark, ["s"], messages, [], [])
    assert [r.reason for r in C.reasons(*t).collect()] == ["no_reply"]
    t = tables(spark, ["s"], [lost, *messages], [], [])
    assert not C.reasons(*t).collect()
    assert [r.text for r in C.conversations(*t).orderBy("turn").collect()] == [f"m{i}" for i in range(7)] + ["reply"]
    # with true clocks the same times say that it came before the last question, so that stays without reply
    true = [(s, i, r, x, at(20 * i + 1000)) for s, i, r, x, _ in messages]
    t = tables(spark, ["s"], [lost, *true], [], [])
    assert [r.reason for r in C.reasons(*t).collect()] == ["no_reply"]
    # question, answer, question, answer: no offset puts every answer after its question and before the next
    odd = [("s", i, "user" if i % 2 == 0 else "assistant", f"m{i}", at(x)) for i, x in enumerate((0, 50, 20, 10))]
    t = tables(spark, ["s"], odd, [], [])
    assert {r.feasible for r in C.clock_offsets(C.events(*t[1:])).collect()} == {False}
    assert C.conversations(*t).count() == 4 and C.conversations(*t, clocks_must_agree=True).count() == 0


def test_offsets_obey_the_inequalities():
    rnd = random.Random(3)
    tight = 0
    for _ in range(200):
        true = {"assistant": 0.0, "user": rnd.uniform(-500, 500), "tool": rnd.uniform(-50, 50)}
        gaps = []
        for before, sender in (("user", "assistant"), ("assistant", "user"), ("assistant", "tool"), ("tool", "assistant")):
            seen = [true[sender] - true[before] + rnd.choice([1, 5, 900, 4000]) * rnd.random() for _ in range(rnd.randrange(1, 9))]
            gaps.append((before, sender, len(seen), sum(seen) / len(seen), min(seen)))
        offset, _, feasible = C.solve(gaps)
        assert feasible
        plain = np.array([offset[s] - offset[b] - least for b, s, _, _, least in gaps])
        assert (plain <= 1e-3).all()
        tight += (plain > -1e-3).any()
    assert tight > 20  # the inequalities decided these


def test_messages_without_index_or_time(spark):
    messages = [("s", 0, "user", "q", None), ("s", 1, "assistant", "a", None), ("s", None, "tool", "x", None), ("t", None, "user", "q", None)]
    s, m, c, r = tables(spark, ["s", "t"], messages, [], [])
    m = m.withColumn("sent_at", F.when(F.col("message_index").isNotNull(), F.col("sent_at")))
    assert {tuple(x) for x in C.reasons(s, m, c, r).collect()} == {("t", "no_reply")}
    assert [x.text for x in C.conversations(s, m, c, r).orderBy("turn").collect()] == ["q", "a", "x"]
