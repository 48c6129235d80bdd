import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.operators import nested


def test_flatten_links_and_ordinals(spark):
    schema = "id long, row_key string, a array<struct<x int, b array<struct<y string>>>>, tags array<string>"
    df = spark.createDataFrame([(1, "own", [(5, [("p",), None]), None, (6, None)], ["t", None]), (1, "own", [(5, [("p",), None]), None, (6, None)], ["t", None]), (2, None, [], None), (None, "x", [(1, [])], [])], schema)
    t = nested.flatten(df, F.col("id"), "r")
    assert set(t) == {"r", "r.a", "r.a.b", "r.tags"}
    assert {(r.row_key, r.row_key_) for r in t["r"].collect()} == {("1", "own"), ("2", None)}  # a column named like a key keeps its value
    assert {(r.parent_key, r.ordinal, r.x) for r in t["r.a"].collect()} == {("1", 0, 5), ("1", 1, None), ("1", 2, 6)}
    assert {(r.parent_key, r.row_key, r.y) for r in t["r.a.b"].collect()} == {("1/0", "1/0/0", "p"), ("1/0", "1/0/1", None)}
    assert {(r.ordinal, r.value) for r in t["r.tags"].collect()} == {(0, "t"), (1, None)}
    empty = nested.flatten(df.limit(0), F.col("id"), "r")
    assert all(x.count() == 0 for x in empty.values())


CASES = [
    (1, '{"command": "ls", "a": {"file_path": null, "pattern": {"command": ["x", {"pattern": 1}]}}}', {"$.command", "$.a.pattern.command", "$.a.pattern.command[1].pattern"}),
    (2, json.dumps(json.dumps({"b": [{"file_path": ""}, [{"pattern": False}]]})), {"$.b[0].file_path", "$.b[1][0].pattern"}),
    (3, '{"command": "cut', set()),
    (4, None, set()),
    (5, "", set()),
    (6, '"{\\"command\\""', set()),
    (7, '["command", {"command": 1}]', set()),
    (8, '{"comm\\u0061nd": 2}', {"$.command"}),
    (9, '"\\"{\\\\\\"command\\\\\\": 1}\\""', set()),
]


def test_json_nodes(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t, _ in CASES], "id long, input string, kind string")
    got = nested.json_nodes(df, "input", ("command", "file_path", "pattern"))
    assert got.columns == ["id", "kind_", "json_path", "member", "kind", "value", "row_path", "parent_path", "ordinal"]
    found = {}
    for r in got.collect():
        found.setdefault(r.id, set()).add(r.json_path)
    assert found == {i: paths for i, _, paths in CASES if paths}
    assert nested.json_nodes(df.limit(0), "input").count() == 0


def test_merged_schema(spark):
    df = spark.createDataFrame([('{"a": [1, "x", {"b": null}]}',), ('{"a": 2}',)], "input string")
    got = {r.field: r.kinds for r in nested.merged_schema(nested.json_nodes(df, "input")).collect()}
    assert got == {"$": "object", "$.a": "array,number", "$.a[]": "number,object,string", "$.a[].b": "null"}


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "command", "pattern"]), x, max_size=3), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(values)
def test_walk_reaches_every_value(value):
    def count(v):
        return 1 + sum(map(count, v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))

    assert len(list(nested.walk(value))) == count(value)


def test_depth_is_no_limit(spark):
    n = 100_000
    deep = '{"a":[' * (n // 2) + '{"command": "ls", "pattern": [1, {"x": null}]}' + "]}" * (n // 2)
    for text in (deep, json.dumps(deep)):
        root = nested.parse_object(text)
        assert sum(1 for _ in nested.walk(root)) == n + 6
    df = spark.createDataFrame([(1, deep), (2, deep[:-1]), (3, deep + "]")], "id long, input string")
    got = nested.json_nodes(df, "input", ("command", "pattern")).collect()
    assert {(r.id, r.member, r.value) for r in got} == {(1, "command", "ls"), (1, "pattern", '[1,{"x":null}]')}
    assert all(r.json_path.count("[0]") == n // 2 for r in got)


def test_deep_parser_and_writer_equal_the_library():
    from lakeweave.functions import jsontext

    for text in ('{"a": [1, -2.5e3, "x\\u00e9", null, true, {}], "b": {"c": []}}', " [ ] ", '"x"', "3", '{"a":1,"a":2}', "[1,[2,[3]]]"):
        assert jsontext._loads_deep(text) == json.loads(text)
        assert "".join(jsontext._pieces(json.loads(text))) == jsontext.dumps(json.loads(text))
    for text in ("", "[", "[1,]", '{"a"}', '{"a":}', "[1]]", "nul", '{"a":1,}', "{1:2}", '["x]', "[1 2]"):
        with pytest.raises(ValueError):
            jsontext._loads_deep(text)
    deep: list = []
    for _ in range(50_000):
        deep = [deep]
    assert jsontext.dumps(deep) == "[" * 50_001 + "]" * 50_001


def test_json_rows_and_tables(spark):
    texts = ['{"command": "ls", "edits": [{"old": "a", "new": {"t": 1}, "tags": ["x", null]}, "plain", null], "a.b": 1, "a": {"b": 2}}', '{"edits": []}', "cut{"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, input string")
    nodes = nested.json_nodes(df, "input")
    rows = nested.json_rows(nodes, ["id"])
    got = {(r.id, r.level, r.row_key, r.parent_key, r.ordinal): r.fields for r in rows.collect()}
    assert got == {
        (0, "$", "$", None, None): {"command": "ls", "a.b": "1"},
        (0, "$.edits[]", "$.edits[0]", "$", 0): {"old": "a", "new.t": "1"},
        (0, "$.edits[]", "$.edits[1]", "$", 1): {"": "plain"},
        (0, "$.edits[]", "$.edits[2]", "$", 2): {"": "null"},
        (0, "$.edits[].tags[]", "$.edits[0].tags[0]", "$.edits[0]", 0): {"": "x"},
        (0, "$.edits[].tags[]", "$.edits[0].tags[1]", "$.edits[0]", 1): {"": "null"},
        (1, "$", "$", None, None): {},
    }
    tables = nested.json_tables(rows, ["id"], nested.merged_schema(nodes))
    assert set(tables) == {"$", "$.edits[]", "$.edits[].tags[]"}
    assert [tuple(r) for r in tables["$.edits[]"].orderBy("ordinal").collect()] == [(0, "$.edits[0]", "$", 0, None, "1", "a"), (0, "$.edits[1]", "$", 1, "plain", None, None), (0, "$.edits[2]", "$", 2, "null", None, None)]
