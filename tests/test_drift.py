import json
import random
from datetime import datetime, timedelta

from lakeweave.operators import drift


def brute(files, lines):
    """(file_id, field, change, new_field) by the definition, in plain Python."""
    fields = {}
    for file_id, _, line in lines:
        try:
            rec = json.loads(line) if line else None
        except ValueError:
            continue
        if isinstance(rec, dict):
            stack = [(rec.get("type", ""), [], rec)]
            while stack:
                path, above, v = stack.pop()
                if v is None:
                    continue
                kind = {str: "string", bool: "boolean", dict: "object", list: "array"}.get(type(v), "number")
                fields.setdefault(file_id, {}).setdefault(path, [above, set()])[1].add(kind)
                inner = [(f"{path}.{k}", w) for k, w in v.items()] if kind == "object" else [(f"{path}[]", w) for w in v] if kind == "array" else []
                stack += [(p, [*above, path], w) for p, w in inner]
    out = set()
    agents = {}
    for f in files:
        agents.setdefault(f[1], []).append((f[2], f[0]))
    for rows in agents.values():
        rows = sorted(set(rows))
        for (_, a), (_, b) in zip(rows, rows[1:]):
            x, y = fields.get(a, {}), fields.get(b, {})
            gone, come = {p for p in x if p not in y}, {p for p in y if p not in x}
            kept = {p for p in x if p in y and x[p][1] != y[p][1]}
            new_name = {}
            for p in gone:
                parent, kinds = x[p][0][-1:], x[p][1]
                g = [q for q in gone if x[q][0][-1:] == parent and x[q][1] == kinds]
                c = [q for q in come if y[q][0][-1:] == parent and y[q][1] == kinds]
                if len(g) == len(c) == 1:
                    new_name[p] = c[0]
            told = gone | come | kept
            for p in told:
                if set((x.get(p) or y[p])[0]) & told:
                    continue
                if p in new_name:
                    out.add((b, p, "renamed", new_name[p]))
                elif p not in new_name.values():
                    out.add((b, p, "added" if p in come else "removed" if p in gone else "retyped", ""))
    return out


def run(spark, files, lines):
    f = spark.createDataFrame(files, "file_id long, agent_id string, written_at timestamp")
    l = spark.createDataFrame(lines, "file_id long, record_index int, line string")
    rows = drift.changes(drift.field_catalogue(l), drift.number_files(f, "agent_id", "written_at")).collect()
    out = [(r.file_id, r.field, r.change, r.new_field) for r in rows]
    assert len(out) == len(set(out))
    return set(out)


T = datetime(2025, 1, 1)


def test_kinds_of_change(spark):
    files = [(9, "a", T), (3, "a", T + timedelta(hours=1)), (5, "a", T + timedelta(hours=2)), (7, "b", T)]
    lines = [
        (9, 0, '{"type":"t","p":{"id":1,"x":[{"k":1}],"n":null},"old":{"deep":1}}'),
        (9, 1, "null"), (9, 2, ""), (9, 3, '{"cut'), (9, 4, None),
        (3, 0, '{"type":"t","p":{"session":2,"x":[{"k":"s"},{"k":1}]},"new":[{"deep":1}]}'),
        (3, 0, '{"type":"t","p":{"session":2,"x":[{"k":"s"},{"k":1}]},"new":[{"deep":1}]}'),
        (7, 0, '{"type":"t"}'),
    ]
    got = run(spark, files, lines)
    assert got == brute(files, lines)
    assert (3, "t.p.id", "renamed", "t.p.session") in got
    assert (3, "t.p.x[].k", "retyped", "") in got
    assert {(3, "t.old", "removed", ""), (3, "t.new", "added", "")} <= got
    assert (5, "t", "removed", "") in got  # a file without lines has no fields
    assert not any(f == 7 for f, *_ in got)


def test_random_files_against_brute_force(spark):
    rnd = random.Random(3)

    def value(d):
        k = rnd.randrange(7)
        if k < 2 and d < 3:
            return {rnd.choice("abcd"): value(d + 1) for _ in range(rnd.randrange(3))}
        if k == 2 and d < 3:
            return [value(d + 1) for _ in range(rnd.randrange(3))]
        return rnd.choice([1, "s", True, None, 2.5])

    files = [(i, rnd.choice("xyz"), T + timedelta(hours=rnd.randrange(30))) for i in range(40)]
    lines = [(rnd.randrange(40), i, json.dumps({"type": rnd.choice(["t", "u"]), "v": value(0), "w": value(0)})) for i in range(150)]
    assert run(spark, files, lines) == brute(files, lines)


def test_empty_tables_and_casts(spark):
    assert run(spark, [], []) == set()
    l = spark.createDataFrame([(1, 0, '{"type":"t","a":1,"b":"x","c":true,"d":{"e":1}}'), (2, 0, '{"type":"t","a":"1","b":null,"c":false,"d":"j"}')], "file_id long, record_index int, line string")
    cat = drift.field_catalogue(l)
    aliases = spark.createDataFrame([("t.b", "t.bb")], "field string, canonical string")
    got = {r.field: (r.kinds, r.read_as) for r in drift.cast_table(cat, aliases).collect()}
    assert got["t.a"] == ("number,string", "string") and got["t.bb"] == ("string", "string") and got["t.c"] == ("boolean", "boolean") and got["t.d"] == ("object,string", "json")
    vals = {(r.record_index, r.file_id, r.field, r.source_path, r.value) for r in drift.unify(drift.record_values(l), aliases).collect()}
    assert (0, 1, "t.bb", "t.b", "x") in vals and (0, 1, "t.d.e", "t.d.e", "1") in vals


def test_renamed_objects_carry_what_is_beneath_them(spark):
    files = [(i, "a", T + timedelta(hours=i)) for i in range(1, 5)]
    lines = [
        (1, 0, '{"type":"t","p":{"old":{"id":1,"list":[{"n":2}]}},"m":"x"}'),
        (2, 0, '{"type":"t","p":{"mid":{"id":3,"list":[{"n":4}]}},"m":{"k":true}}'),
        (3, 0, '{"type":"t","p":{"new":{"id":5,"list":[{"n":6}]}},"m":{"k":false}}'),
        (4, 0, '{"type":"t","p":{"new":{"key":7,"list":[{"n":8}]}},"m":{"k":false}}'),
    ]
    f = spark.createDataFrame(files, "file_id long, agent_id string, written_at timestamp")
    l = spark.createDataFrame(lines, "file_id long, record_index int, line string")
    cat = drift.field_catalogue(l)
    aliases = drift.alias_table(drift.changes(cat, drift.number_files(f, "agent_id", "written_at")))
    assert {tuple(r) for r in aliases.collect()} == {("t.p.old", "t.p.new"), ("t.p.mid", "t.p.new"), ("t.p.new.id", "t.p.new.key")}
    casts = drift.cast_table(cat, aliases)
    by_field = {r.field: (r.names, r.read_as, r.n_files) for r in casts.collect()}
    assert by_field["t.p.new.key"] == ("t.p.mid.id,t.p.new.id,t.p.new.key,t.p.old.id", "double", 4)
    assert by_field["t.p.new.list[].n"] == ("t.p.mid.list[].n,t.p.new.list[].n,t.p.old.list[].n", "double", 4)
    assert not [x for x in by_field if x.startswith(("t.p.old", "t.p.mid"))]
    rows = drift.unify(drift.record_values(l, drift.mixed_fields(cat, aliases)), aliases, casts).collect()
    assert sorted((r.as_double, r.source_path) for r in rows if r.field == "t.p.new.key") == [(1.0, "t.p.old.id"), (3.0, "t.p.mid.id"), (5.0, "t.p.new.id"), (7.0, "t.p.new.key")]
    assert sorted(r.as_double for r in rows if r.field == "t.p.new.list[].n") == [2.0, 4.0, 6.0, 8.0]
    assert sorted((r.file_id, r.read_as, json.dumps(json.loads(r.value))) for r in rows if r.field == "t.m") == [(1, "json", '"x"'), (2, "json", '{"k": true}'), (3, "json", '{"k": false}'), (4, "json", '{"k": false}')]
    assert sorted((r.file_id, r.as_boolean) for r in rows if r.field == "t.m.k") == [(2, True), (3, False), (4, False)]


def test_canonical_names():
    assert drift.canonical_names([("t.a", "t.b", 3), ("t.b", "t.a", 1), ("t.b", "t.c", 3)]) == {"t.a": "t.c", "t.b": "t.c"}
    assert drift.canonical_names([("t.a", "t.b", 1), ("t.b", "t.a", 1)]) == {"t.a": "t.b"}
    # a field renamed beneath an old name of its parent
    names = drift.canonical_names([("t.o.x", "t.o.y", 1), ("t.o", "t.n", 1)])
    assert [drift.canonical_name(p, names) for p in ("t.o.x[].z", "t.n.x", "t.o.y", "t.other.x", "t.o")] == ["t.n.y[].z", "t.n.y", "t.n.y", "t.other.x", "t.n"]


def test_depth_is_no_limit(spark):
    deep = lambda n, leaf: '{"type":"t","p":' + '{"a":' * n + leaf + "}" * n + "}"
    assert drift.load_object(deep(100_000, "1"))["type"] == "t"
    lines = [(1, deep(1500, "1")), (2, deep(1500, '"x"')), (3, deep(1500, '"x"')[:-1])]
    df = spark.createDataFrame(lines, "file_id long, line string")
    files = spark.createDataFrame([(1, "g", 1), (2, "g", 2), (3, "g", 3)], "file_id long, agent string, at long")
    got = drift.changes(drift.field_catalogue(df), drift.number_files(files, "agent", "at")).collect()
    assert {(r.file_id, r.field.count(".a"), r.change) for r in got} == {(2, 1500, "retyped"), (3, 0, "removed")}
