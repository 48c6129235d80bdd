"""Nested records into related flat tables.

``flatten`` takes the schema the reader merged, explodes every array level into a
child table and carries the parent's surrogate key and the element's ordinal, so
each child row joins back to exactly one parent row. JSON held as text has no
schema of its own: ``json_nodes`` takes it apart level by level and gives every node
with its path, the key of the object or array element it belongs to and its ordinal there;
``merged_schema`` merges what was seen into one schema, and ``json_tables`` makes a
child table of each array level of that schema.

Defined results: a null or empty array gives no child row; a null element keeps
its ordinal and gives a row of nulls; repeated input rows count once; text that
is no JSON (cut, empty, null) gives no node; text that is a JSON string is
decoded once more; an empty table gives empty tables; columns named like the
keys (``parent_key``, ``ordinal``, ``row_key``) are kept with a trailing ``_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import jsontext
from lakeweave.functions.arrow import map_arrow

KEYS = ("row_key", "parent_key", "ordinal")


def _leaves(prefix: Column, schema: T.StructType, name: str = "") -> tuple[list[Column], list[tuple[str, Column, T.DataType]]]:
    """Scalar columns of a struct (inner structs opened) and its arrays."""
    flat, arrays = [], []
    for f in schema.fields:
        label = f"{name}_{f.name}" if name else f.name
        label = f"{label}_" if label in KEYS else label
        col = prefix.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            a, b = _leaves(col, f.dataType, label)
            flat, arrays = flat + a, arrays + b
        elif isinstance(f.dataType, T.ArrayType):
            arrays.append((label, col, f.dataType.elementType))
        else:
            flat.append(col.alias(label))
    return flat, arrays


def flatten(df: DataFrame, key: Column, root: str = "root") -> dict[str, DataFrame]:
    """One table per array level of ``df``; ``key`` names a record.

    The surrogate key of a child is its parent's key, the ordinal after it:
    ``17/3/0`` is element 0 of the child 3 of record 17. Keys are made from data,
    not from row numbers, so a task that runs again makes the same ones.
    """
    out: dict[str, DataFrame] = {}

    def level(rows: DataFrame, element: T.DataType, label: str) -> None:
        keys = [c for c in KEYS if c in rows.columns]
        if not isinstance(element, T.StructType):
            if isinstance(element, T.ArrayType):
                arrays, flat = [("items", F.col("el"), element.elementType)], []
            else:
                arrays, flat = [], [F.col("el").alias("value")]
        else:
            flat, arrays = _leaves(F.col("el"), element)
        out[label] = rows.select(*keys, *flat)
        for name, col, inner in arrays:
            child = rows.select(F.col("row_key").alias("parent_key"), F.posexplode(col).alias("ordinal", "el"))
            child = child.withColumn("row_key", F.concat_ws("/", "parent_key", F.col("ordinal").cast("string")))
            level(child, inner, f"{label}.{name}")

    rows = df.select(key.cast("string").alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("el"))
    rows = rows.filter(F.col("row_key").isNotNull()).dropDuplicates(["row_key"])
    level(rows, df.schema, root)
    return out


def kind_of(value: object) -> str:
    """The JSON kind of a decoded value; null has none."""
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, dict):
        return "object"
    return "array" if isinstance(value, list) else ""


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, decoded twice where it was encoded twice; else None. Depth is no limit."""
    if not text:
        return None
    try:
        value = jsontext.loads(text)
        if isinstance(value, str):
            value = jsontext.loads(value)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


class Node:
    """A value in a JSON tree; paths and keys are put together from its ancestors when they are asked for."""

    __slots__ = ("above", "piece", "member", "ordinal", "value")

    def __init__(self, above: Node | None, piece: str, member: str | None, ordinal: int | None, value: object):
        self.above, self.piece, self.member, self.ordinal, self.value = above, piece, member, ordinal, value

    def path(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(at.piece)
            at = at.above
        return "".join(reversed(parts))

    def row(self) -> Node:
        """The node whose row this one is a column of: the nearest element of an array, or the root."""
        at = self
        while at.ordinal is None and at.above is not None:
            at = at.above
        return at


def walk(value: object, path: str = "$") -> Iterator[Node]:
    """Every node under ``value``, level by level of each branch, with a stack: depth is no limit."""
    stack = [Node(None, path, None, None, value)]
    while stack:
        node = stack.pop()
        yield node
        v = node.value
        if isinstance(v, dict):
            stack += [Node(node, f".{k}", k, None, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [Node(node, f"[{i}]", None, i, x) for i, x in reversed(list(enumerate(v)))]


NODE_COLUMNS = ("json_path", "member", "kind", "value", "row_path", "parent_path", "ordinal")
#: Characters of paths and values that one batch holds at most, but for one node.
BATCH_CHARS = 32_000_000


def json_nodes(df: DataFrame, text: str, members: tuple[str, ...] | None = None) -> DataFrame:
    """Every node of the JSON text in column ``text`` (or only the named members), beside the other columns.

    ``row_path`` is the path of the array element (or the root, ``$``) whose row the node
    belongs to, and with the other columns the key of that row; ``ordinal`` is the node's own
    place where it is an array element, and ``parent_path`` then the row around its array. With ``members``, values that are null or objects are
    left out; a list counts once.
    """
    keep = [f for f in df.schema.fields if f.name != text]
    named = [T.StructField(f"{f.name}_" if f.name in NODE_COLUMNS else f.name, f.dataType) for f in keep]
    kinds = {c: T.IntegerType() if c == "ordinal" else T.StringType() for c in NODE_COLUMNS}
    schema = T.StructType([*named, *(T.StructField(c, k) for c, k in kinds.items())])
    wanted = None if members is None else frozenset(members)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, cols, size = [], {c: [] for c in NODE_COLUMNS}, 0

        def told() -> pa.RecordBatch:
            kept = [batch.column(f.name).take(pa.array(at, pa.int64())) for f in keep]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int32() if c == "ordinal" else pa.string()) for c, v in cols.items())], names=schema.fieldNames())

        for i, t in enumerate(batch.column(text).to_pylist()):
            if wanted is not None and (not t or not any(m in t for m in wanted) and "\\u" not in t):
                continue
            root = parse_object(t)
            if root is None:
                continue
            for node in walk(root):
                value, kind = node.value, kind_of(node.value)
                if wanted is not None and (node.member not in wanted or kind in ("", "object")):
                    continue
                plain = None if kind in ("", "object") and wanted is None and value is not None else value if isinstance(value, str) else jsontext.dumps(value)
                path, row = node.path(), node.row()
                around = node.above.row().path() if node.ordinal is not None else None
                at.append(i)
                for c, v in zip(NODE_COLUMNS, (path, node.member, kind or "null", plain, path if row is node else row.path(), around, node.ordinal)):
                    cols[c].append(v)
                size += 3 * len(path) + len(plain or "")
                if size > BATCH_CHARS:
                    yield told()
                    at, cols, size = [], {c: [] for c in NODE_COLUMNS}, 0
        yield told()

    return map_arrow(df, run, schema)


def json_rows(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, row_key, parent_key, ordinal, fields): a row for each input and for each element of an array in it.

    level is the element's path with positions merged (``$``, ``$.edits[]``); row_key its path,
    parent_key that of the row around it; fields are its values by their path below it, those of
    inner objects included, arrays left out: they are rows of a level of their own.
    """
    own = F.col("ordinal").isNotNull() | (F.col("json_path") == "$")
    below = F.when(own, F.lit("")).otherwise(F.substring("json_path", F.length("row_path") + 2, F.length("json_path")))
    value = F.when(~F.col("kind").isin("object", "array"), F.struct(below.alias("key"), F.col("value").alias("value")))
    out = nodes.groupBy(*keys, "row_path").agg(F.max("ordinal").alias("ordinal"), F.max("parent_path").alias("parent_key"), F.array_sort(F.collect_list(value)).alias("found"))
    # names with points in them may clash with inner objects: the first value stays
    fields = F.map_from_entries(F.filter("found", lambda e, i: (i == 0) | (F.get("found", i - 1)["key"] != e["key"])))
    return out.select(*keys, F.regexp_replace("row_path", r"\[\d+\]", "[]").alias("level"), F.col("row_path").alias("row_key"), "parent_key", "ordinal", fields.alias("fields"))


def json_tables(rows: DataFrame, keys: list[str], schema: DataFrame) -> dict[str, DataFrame]:
    """A table for each array level of the merged schema (and ``$``), with a column for each scalar field of the level.

    The schema's rows follow the number of field names; they are the columns made here.
    """
    levels: dict[str, list[str]] = {"$": []}
    for field, kinds in sorted((r["field"], r["kinds"]) for r in schema.select("field", "kinds").collect()):
        head, mark, rest = field.rpartition("[]")
        level = head + mark or "$"
        levels.setdefault(level, [])
        if set(kinds.split(",")) - {"object", "array", "null"}:
            levels[level].append(rest.lstrip(".") if mark else field[2:])
    return {level: rows.filter(F.col("level") == level).select(*keys, "row_key", "parent_key", "ordinal", *[F.col("fields").getItem(x).alias(x or "value") for x in fields]) for level, fields in levels.items()}


def merged_schema(nodes: DataFrame) -> DataFrame:
    """One row per path with array positions merged (``[]``): its kinds and how often it stands.

    A path with several kinds has them all, so no reader of the merged schema loses a value.
    """
    path = F.regexp_replace("json_path", r"\[\d+\]", "[]")
    return nodes.groupBy(path.alias("field")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n_values"))
