from pyspark.sql import functions as F

from lakeweave.operators import transcript as R

CALLS = "session_id string, message_index int, pos int, call_id string, tool string, input_json string, path string, command string"
RESULTS = "session_id string, message_index int, pos int, call_id string, result_id long, text string, is_error boolean, returned_at timestamp"


def tables(spark, calls, results):
    return spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)


def test_supersession(spark):
    calls = [
        ("s", 1, 0, "a", "Read", '{"file_path": "f.py"}', None, None),
        ("s", 3, 0, "b", "mcp__x__Edit", '{"file_path": "f.py"}', None, None),
        ("s", 5, 0, "c", "Read", '{"file_path": "f.py", "offset": 3}', None, None),
        ("s", 7, 0, "d", "read", '{"file_path": "f.py"}', None, None),
        ("s", 9, 0, "e", "Bash", '{"command": "ls"}', None, None),
        ("s", 9, 1, "f", "Bash", '{"command": "ls"}', None, None),
        ("s", 9, 2, "g", "Bash", None, None, "ls"),
        ("s", 9, 3, "h", "Grep", '{"cut', None, None),
        ("s", 9, 3, "h", "Grep", '{"cut', None, None),
    ]
    results = [("s", i + 2, 0, c, i, {"e": "x", "f": "x", "g": "y"}.get(c, c), False, None) for i, c in enumerate("abcdefgh")]
    s = R.stream(*tables(spark, calls, results))
    got = {r.call_id: r.superseded_by for r in R.superseded(s).collect()}
    # the partial view and the changed rerun replace nothing
    assert got == {"a": "d", "b": "d", "c": "d", "d": None, "e": "f", "f": None, "g": None, "h": None}
    p = {r.call_id: r.protection for r in R.protected(s).collect()}
    assert p["b"] == "latest_artifact_edit" and p["h"] == "latest_tool_result"


def test_rules_and_apply(spark):
    calls = [("s", i, 0, f"c{i}", "Bash" if i % 2 else "Grep", None, None, f"cmd {i}" if i % 2 else None) for i in range(60)]
    results = [("s", i, 0, f"c{i}", i, ("out %d " % i) * (900 if i == 1 else 1), i == 50, None) for i in range(60)]
    c, r = tables(spark, calls, results)
    s = R.stream(c, r)
    last = spark.createDataFrame([("s", 59)], "session_id string, last_index int")
    d = R.rules(s, last)
    got = {x.call_id: (x.action, x.reason) for x in d.collect()}
    assert got["c0"] == ("keep", "pinned") and got["c59"] == ("keep", "pinned")
    assert got["c1"] == ("trim", "large_old_output_trimmed")
    assert got["c2"] == ("drop", "stale_read_far_from_recent_work")
    assert got["c50"] == ("keep", "latest_error_result") and got["c49"] == ("keep", "call_before_latest_error")
    texts = {x.call_id: x.text for x in R.compacted(s, d, r).collect()}
    assert "c2" not in texts and texts["c3"] == "out 3 " and len(texts["c1"]) < 2200 and "[removed: 1 lines, 5.3 KB, id " in texts["c1"]
    assert R.rules(s.limit(0), last).count() == 0


def test_pointers_stash_and_replay(spark):
    calls = [("s", i, 0, f"c{i}", "Bash", None, None, "x") for i in range(4)]
    text = "Chunk ID: 7\nline " + "y" * 60
    results = [("s", 0, 0, "c0", 1, text, None, None), ("s", 1, 0, "c1", 2, "short", None, None), ("s", 2, 0, "c2", 3, text.replace("7", "9"), None, None), ("s", 3, 0, "c3", 4, None, None, None)]
    c, r = tables(spark, calls, results)
    assert [(x.call_id, x.points_to) for x in R.pointers(R.stream(c, r)).collect()] == [("c0", "c2")]
    put = R.stash_put(r, 10)
    assert put.count() == 2
    wanted = put.select(F.substring("sha256", 1, 12).alias("id12")).unionByName(spark.createDataFrame([("0" * 12,)], "id12 string"))
    assert sorted(x.outcome for x in R.recall(put, wanted).collect()) == ["missing", "ok", "ok"]
    named = put.limit(1).select(F.concat(F.lit("please recall "), F.substring("sha256", 1, 12)).alias("text"))
    assert R.unreferenced(put, named).count() == 1
    e = spark.createDataFrame([("s", i, 10, i in (2, 3, 6), i == 4) for i in range(7)], "session_id string, seq int, tokens int, is_request boolean, is_boundary boolean")
    assert [x.requests_after for x in R.replay(e).orderBy("seq").collect()] == [2, 2, 1, 0, 1, 1, 0]
