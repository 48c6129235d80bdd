import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import udtf
from lakeweave.operators import compaction, segments, spans, speech, vectors
from lakeweave.sources import sessions, tables
from lakeweave.streaming import live

EDGES = ["", "   ", "\n", "a", "x" * 20000, "a\rb\r\rc", "a\r\n\r\nb\nc\rd", "```\nopen\n\nstill", "p\n\n```py\ncode\n\n\nmore\n```\n\nq", "~~~\n```\n~~~\nafter", "\n\nlead\n\n\n", "line\n" * 4000, "no newline " * 1500, "x\r\n" * 3000]


@pytest.mark.parametrize("text", EDGES)
def test_blocks_and_gaps_are_the_text(text):
    parts = segments.block_spans(text, 6000)
    at = 0
    for s, e in parts:
        assert at <= s < e and not text[at:s].strip()
        assert e - s <= 6000 + segments.BLOCK_LEAST + 1 or "\n" not in text[s:e]
        assert text[e - 1 : e + 1] != "\r\n"
        at = e
    assert not text[at:].strip()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab `~|-\n\r\t", max_size=120), st.integers(20, 60))
def test_blocks_of_random_texts(text, most):
    parts = segments.block_spans(text, most)
    assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    left = "".join(text[e:s] for e, s in zip([0, *(p[1] for p in parts)], [*(p[0] for p in parts), len(text)]))
    assert not left.strip()


def test_fences_stay_whole_and_protected():
    text = "p\n\n```py\ncode\n\n\nmore\n```\n\nq"
    assert [text[s:e] for s, e in segments.block_spans(text)] == ["p\n", "```py\ncode\n\n\nmore\n```\n", "q"]
    clean, count = segments.normalize("﻿a  b \n\n\n\n| x  | y |\n|---|---|\n| 1   | 2 |\n\n```\nkeep   me  \n\n\n\n```\nend \r\n")
    assert clean == "a b\n\n| x  | y |\n|---|---|\n| 1   | 2 |\n\n```\nkeep   me  \n\n\n\n```\nend"
    assert count == {"bom": 1, "line_ends": 1, "trailing": 2, "inner": 1}
    assert segments.normalize(clean)[0] == clean


def test_near_repeats():
    long = "Each evening the harbour master rows out to light the green lamp on pier nine."
    kept, exact, near = segments.near_unique("\n\n".join([long, "short", long.replace("nine", "none"), "  ".join(long.split()), "shorT", long[::-1]]))
    assert (kept, exact, near) == ([long, "short", "shorT", long[::-1]], 1, 1)


def test_near_repeats_against_comparing_all():
    from difflib import SequenceMatcher

    rnd = random.Random(8)
    for _ in range(30):
        base = ["".join(rnd.choice("abcdefg hij") for _ in range(rnd.choice([30, 41, 60, 150, 420]))).strip() or "x" for _ in range(4)]
        parts = []
        for _ in range(25):
            c = list(rnd.choice(base))
            for _ in range(rnd.randrange(0, max(1, len(c) // 12))):
                at = rnd.randrange(len(c))
                c[at : at + rnd.randrange(2)] = [rnd.choice("XYZ")] * rnd.randrange(2)
            parts.append("".join(c).strip() or "x")
        kept, keys = [], []
        for p in parts:
            key = " ".join(p.split())
            if key in [" ".join(k.split()) for k in kept]:
                continue
            if len(key) >= 40 and any(SequenceMatcher(None, k, key.lower()).ratio() >= 0.95 for k in keys):
                continue
            kept.append(p)
            if len(key) >= 40:
                keys.append(key.lower())
        assert segments.near_unique("\n\n".join(parts))[0] == kept


def test_pieces_end_at_lines():
    text = "".join(f"line {i}\r\n" for i in range(3000))
    spans = segments._pieces(text, 0, len(text), 1000)
    assert "".join(text[s:e] for s, e in spans) == text and all(e - s <= 1001 and text[s:e].endswith("\r\n") for s, e in spans[:-1])
    assert segments._pieces("x" * 2050, 0, 2050, 1000) == [(0, 1000), (1000, 2050)]
    assert segments._pieces("x" * 999 + "\r\n" + "y" * 500, 0, 1501, 1000) == [(0, 1001), (1001, 1501)]


def test_blocks_table_and_sql(spark):
    df = spark.createDataFrame([*enumerate(EDGES), (99, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in segments.rebuilt(segments.blocks(df)).collect()}
    assert back == {i: t for i, t in enumerate(EDGES) if t}
    udtf.register(spark)
    rows = spark.sql("SELECT doc_id, p.idx, p.paragraph FROM {d}, LATERAL paragraphs(text) p WHERE doc_id = 8", d=df).collect()
    assert [(r.idx, r.paragraph) for r in rows] == [(0, "p"), (1, "```py\ncode\n\n\nmore\n```"), (2, "q")]
    n = spark.sql("SELECT j.json_path FROM VALUES ('{\"a\":[1]}') AS t(x), LATERAL json_nodes(x) j").collect()
    assert [r[0] for r in n] == ["$", "$.a", "$.a[0]"]
    c = segments.cleaned(df).collect()
    assert len(c) == len(EDGES) + 1


def test_sentences(spark):
    df = spark.createDataFrame([(1, "The pump leaks. Please fix the pump!\nNever touch the red valve. Why?"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.idx, r.role, r.topic) for r in segments.sentences(df).orderBy("idx").collect()]
    assert got == [(0, "context", 1), (1, "ask", 1), (2, "constraint", 2), (3, "ask", 3)]


def test_merge_overlap_and_removed(spark):
    rnd = random.Random(1)
    a = [(rnd.randrange(3), s, s + rnd.randrange(0, 9000)) for s in (rnd.randrange(20000) for _ in range(60))]
    b = [(rnd.randrange(3), s, s + rnd.randrange(0, 50)) for s in (rnd.randrange(20000) for _ in range(60))]
    schema = "k int, span_start int, span_end int"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted((r.k, r.ls, r.le, r.rs, r.re) for r in spans.overlaps(da, db, "k").collect())
    assert got == sorted((k, s, e, x, y) for k, s, e in a for j, x, y in b if k == j and s < y and x < e and s < e and x < y)
    cover = {(k, i) for k, s, e in a for i in range(s, e)}
    merged = spans.merge_spans(da, "k").collect()
    assert sum(r.span_end - r.span_start for r in merged) == len(cover)
    assert sum(r.n for r in merged) == sum(e > s for _, s, e in a)
    texts = spark.createDataFrame([(0, "0123456789"), (1, "héllo😀wörld"), (2, None)], "k int, text string")
    cut = spark.createDataFrame([(0, 2, 4), (0, 3, 5), (0, 9, 10), (1, 5, 6), (1, 0, 1)], schema)
    assert {r.k: r.text for r in spans.removed(texts, cut, "k").collect()} == {0: "015678", 1: "éllowörld", 2: None}


def test_as_of_keeps_ties_and_nulls(spark):
    l = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "id int, k string, t int")
    r = spark.createDataFrame([("a", 5, "x"), ("a", 2, "y"), ("a", 6, None)], "k string, t int, v string")
    assert {x.id: x.v for x in spans.as_of(l, r, "k", "t", "v").collect()} == {1: "x", 2: None, 3: None, 4: "x"}


def test_speech(spark):
    df = spark.createDataFrame([(1, "Uh, the pump, you know, is is broken [Music] at (01:23)"), (2, "A: hi\nB: ho"), (3, "plain text"), (4, None)], "doc_id long, text string")
    assert [r[0] for r in df.select(speech.is_speech(F.col("text"))).collect()] == [True, True, False, None]
    r = speech.removals(df)
    clean = {x.doc_id: x.text for x in spans.removed(df, r, "doc_id").collect()}
    assert clean[1] == "the pump, is broken  at " and clean[2] == "A: hi\nB: ho"
    merged = spans.merge_spans(r, "doc_id")
    off = spark.createDataFrame([(1, i) for i in range(len(clean[1]))], "doc_id long, offset int")
    source = df.filter("doc_id = 1").first().text
    assert all(source[x.source] == clean[1][x.offset] for x in speech.remap(off, merged).collect())


def test_compaction_small(spark):
    rows = [(1, i, 100, s, p, k, k * 5, 0, 0) for i, (s, p, k) in enumerate([(0.0, False, "a"), (0.5, False, "b"), (0.0, True, "c"), (0.0, False, "a"), (0.2, False, "d")])]
    c = spark.createDataFrame(rows, "doc_id long, idx long, n_chars long, score double, protected boolean, key string, text string, char_start long, char_end long")
    d = compaction.budget_drop(c)
    assert sorted(r.idx for r in d.collect()) == [0, 3]  # equal chunks go together, one pick is enough
    out = compaction.assembled(c, d).first()
    assert out.n_markers == 2 and out.text.startswith("[1 blocks left out: 100 characters]\n\nbbbbb")
    same = compaction.differences(c.select(F.col("idx").alias("doc_id"), "text"), c.filter("idx < 4").select(F.col("idx").alias("doc_id"), F.when(F.col("idx") == 1, "x").otherwise(F.col("text")).alias("text")))
    assert {r.status: r.n for r in same.collect()} == {"same": 3, "changed": 1, "only_left": 1}


def test_line_range_pointers(spark):
    body = [f"line number {i} with some words in it" for i in range(12)]
    rows = [("s", 1, 0, 10, "\n".join(body[3:8])), ("s", 2, 0, 11, "\r\n".join(body)), ("s", 3, 0, 12, "\n".join(body[:6]) + "\n"), ("s", 4, 0, 13, None), ("t", 9, 0, 14, "\n".join(body))]
    df = spark.createDataFrame(rows, "session_id string, message_index int, pos int, result_id long, text string")
    assert [tuple(r) for r in compaction.line_range_pointers(df).collect()] == [("s", 10, 11, 4, 8)]


def test_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(7, [1.0] * 5)]
    df = spark.createDataFrame(rows + [(None, [1.0] * 5), (900, None), (901, [1.0]), (902, [float("nan")] * 5), (903, [0.0] * 5)], "vec_id long, embedding array<double>")
    assert {r.reason: r.n for r in vectors.check(df, 5).collect()} == {"ok": 199, "null_id": 1, "duplicate_id": 2, "null_vector": 1, "wrong_dims": 1, "not_finite": 1, "zero": 1}
    good = spark.createDataFrame(rows[:200], "vec_id long, embedding array<double>")
    got = vectors.nearest(good, good.filter("vec_id < 4"), 3, block=50).collect()

    def cos(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    for q in range(4):
        want = sorted(((-round(cos(rows[q][1], v), 6), i) for i, v in rows[:200] if i != q))[:3]
        assert [(r.vec_id, r.rank) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, n) for n, (_, i) in enumerate(want, 1)]


LOG = [
    (1, 0, '{"type":"user","message":{"role":"user","content":"hi"}}'),
    (1, 1, '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"t"},{"type":"tool_use","id":"c","name":"Read","input":{"a":1}},{"type":"thinking"}],"usage":{"input_tokens":3,"output_tokens":4}}}'),
    (1, 2, '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"c","content":"r"}]}}'),
    (1, 3, '{"type":"system","subtype":"compact_boundary"}'), (1, 4, '{"cut'), (1, 5, "null"), (1, 6, None),
    (2, 0, '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"text":"x"},{"text":"y"}]}}'),
    (2, 1, '{"type":"response_item","payload":{"type":"function_call","name":"f","call_id":"d","arguments":"{}"}}'),
    (2, 2, '{"type":"response_item","payload":{"type":"function_call_output","call_id":"d","output":{"content":"z"}}}'),
    (2, 3, '{"type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":"7"}}}}'),
    (2, 3, '{"type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":"7"}}}}'),
]


def test_log_events(spark):
    df = spark.createDataFrame(LOG, "file_id long, record_index int, line string")
    got = sorted((r.file_id, r.record_index, r.part, r.kind, r.call_id, r.text, r.input_tokens) for r in sessions.log_events(df).collect())
    call = next(g for g in got if g[3] == "call" and g[0] == 1)
    assert call[4] == "c"
    assert [(g[0], g[1], g[3], g[5], g[6]) for g in got if g[3] != "call"] == [
        (1, 0, "message", "hi", None), (1, 1, "message", "t", None), (1, 1, "usage", None, 3), (1, 2, "result", "r", None), (1, 3, "boundary", None, None),
        (2, 0, "message", "x\ny", None), (2, 2, "result", "z", None), (2, 3, "usage", None, 7),
    ]


def test_chat_history_payload_and_toon(spark):
    lines = ["# started", "#### do", "#### it", "> tool", "answer", "more", "", "#### next", "   "]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert [(r.message, r.role, r.text) for r in sessions.chat_history(df).orderBy("message").collect()] == [(1, "user", "do\nit"), (2, "tool", "tool"), (3, "assistant", "answer\nmore\n"), (4, "user", "next")]
    other = spark.createDataFrame([(1, 0, json.dumps({"role": "a", "tool_calls": [{"id": "c", "name": "n", "input": "{}"}], "tool_results": [{"tool_call_id": "c", "text": "r"}]}))], "transcript_id long, message_index int, item string")
    r = sessions.parse_payload(other).first()
    assert r.toolUses[0].tool_use_id == "c" and r.toolResults[0].text == "r"
    t = spark.createDataFrame([("g", 2, "a,b"), ("g", 1, None), ("h", 3, 'q"')], "g string, n int, s string")
    assert {x.g: x.toon for x in sessions.toon(t, "rows", "g").collect()} == {"g": 'rows[2]{n,s}:\n1,\n2,"a,b"', "h": 'rows[1]{n,s}:\n3,"q\\""'}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nnot json\n{"x": 2}\n')
    rows = sessions.read_json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect()
    assert sorted((r.x or 0, r._bad) for r in rows) == [(0, "not json"), (1, None), (2, None)]
    assert sessions.read_texts(spark, str(tmp_path / "a.jsonl")).first().text.count("\n") == 3
    kept = tables.materialize(spark.range(5).withColumnRenamed("id", "a"), "test")
    assert kept.count() == 5 and "ExistingRDD" not in kept._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = [(1, t0, 1, "a", 1.0), (1, t0, 1, "a", 1.0), (2, t0 + timedelta(minutes=10), 1, "a", 2.0), (3, t0 + timedelta(hours=5), 1, "a", 3.0), (4, t0, 2, "b", 4.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "events.parquet"))
    assert live.run(live.once(stream(), "event_id"), "append").count() == 4
    s = {(r.user_id, r.n) for r in live.run(live.idle_sessions(stream(), "user_id", "1 hour"), "complete").collect()}
    assert s == {(1, 3), (1, 1), (2, 1)}
    w = live.run(live.windows(stream(), "event_type", "1 hour", "30 minutes"), "complete")
    assert {(r.event_type, r.window_start.hour, r.window_start.minute, r.n) for r in w.collect()} == {("a", 0, 0, 3), ("a", 23, 30, 3), ("a", 5, 0, 1), ("a", 4, 30, 1), ("b", 0, 0, 1), ("b", 23, 30, 1)}
    shown = live.run(live.sticky(stream(), "user_id", "event_type"), "append").collect()
    assert sorted((r.user_id, r.event_type, r.nth) for r in shown) == [(1, "a", 1), (1, "a", 2), (2, "b", 1)]


def test_relating(spark):
    from lakeweave.operators import relating

    text = "see https://a.b/c?d and src/app/main.py:35 or setup.py, not ab"
    got = spark.createDataFrame([(text,)], "t string").select(relating.refs(F.col("t"))).first()[0]
    assert got == ["https://a.b/c?d", "/a.b/c", "src/app/main.py", "main.py", "setup.py"]
    stream = spark.createDataFrame([("s", "a", 1, "read", "src/app/main.py"), ("s", "b", 2, "edit", "src/app/main.py"), ("s", "c", 3, "edit", "src/app/other.py"), ("s", "d", 4, "read", None), ("t", "e", 1, "read", "main.py")], "session_id string, call_id string, seq int, tool string, path string")
    texts = spark.createDataFrame([("s", text), ("t", None), (None, text)], "session_id string, text string")
    assert {tuple(r) for r in relating.named_calls(stream, texts).collect()} == {("s", "src/app/main.py", "b", 2), ("s", "main.py", "b", 2)}
    assert {(r.call_id, r.writes_same, r.writes_near) for r in relating.later_writes(stream).collect()} == {("a", 1, 2), ("e", 0, 0)}
    pairs = spark.createDataFrame([("a\nb\nc", "a\nb\nx\ny"), ("a", "a\nb"), ("", "q"), ("p\nq", "p\nq")], "old string, new string")
    assert [r[0] for r in pairs.select(relating.stable_prefix(pairs, "old", "new")).collect()] == [2, 1, 0, 2]
    lines = spark.createDataFrame([("",), (None,), ("{",), ("1",), ('{"a":1}',), ('{"type":"t"}',)], "line string")
    assert {r.reason: r.n for r in relating.line_reasons(lines).collect()} == {"blank": 2, "not_json": 1, "not_object": 1, "no_type": 1, "ok": 1}
    f = spark.createDataFrame([("Réparé ÉTÉ ﬁn",), (None,)], "t string").select(relating.fold("t")).collect()
    assert [r[0] for r in f] == ["repare ete fin", None]


def test_trims():
    from lakeweave.operators.relating import trimmed

    prose = "word " * 300
    assert trimmed(prose, 400, "prose") == prose[:399] and trimmed("word " * 100, 400, "prose") is None
    assert trimmed(prose + "unless it rains", 400, "prose") is None and trimmed("a " * 180 + "but " + "b " * 400, 365, "prose") is None
    table = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 200
    assert trimmed(table, 400, "markdown_table").count("\n| 1") >= 30 and trimmed(table, 400, "markdown_table").startswith("| a | b |\n|---")
    logs = "".join(f"2025-01-01 INFO line {i}\n" for i in range(200))
    out = trimmed(logs, 600, "logs")
    assert out.startswith("2025-01-01 INFO line 0\n") and out.endswith("line 199\n") and len(out) < 700
    assert trimmed('{"a": [' + "1,\n" * 500 + "1]}", 400, "json") is None
    assert trimmed("a risk of overdose " * 60, 400, "high_risk") is None and trimmed("a: 1\n" * 300, 400, "yaml") is None
    assert trimmed("port = 1\n" * 90, 400, "config") == ("port = 1\n" * 45)[:-1].rsplit("\n", 1)[0] and trimmed("port = 1\n" * 90 + "host = x", 400, "config") is None


def test_kinds_of_passages(spark):
    from lakeweave.functions import text as X

    texts = ["the dosage " + "x " * 120, "```py\nx\n```", '{"a"', "<p>x</p> y", "a | b\n---|---\n1 | 2", "a: 1\nb: 2\nc", "INFO x\nWARN y\nz", "import x\ny", "/a/b = 1\nc d\ne f\ng h\n/k = 2", "# Title", "plain words", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.content_type(F.col("t"))).collect()]
    assert got == ["high_risk", "code", "json", "xml", "markdown_table", "yaml", "logs", "code", "config", "markdown", "prose", "prose"]
