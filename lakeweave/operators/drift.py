"""Schemas that drift between files: one catalogue of fields and their lifespans.

Every file gives the fields it holds with their JSON kinds (what a Parquet footer
would hold). Within one producer the files are numbered by time; ``lag`` over the
file numbers of a producer's field marks where an unbroken run (an island) of the
field with the same kinds starts and where it ends. Starts and endings are the
change log, and the alias and cast table that brings all records into one schema
is made from it.

Defined results: blank, cut or non-object lines are ignored, repeated lines count
once, null values give a field no kind, a file without lines has no fields, files
of equal time are ordered by id, and a producer's first file has no changes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import jsontext
from lakeweave.functions.arrow import map_arrow
from lakeweave.operators.nested import kind_of
from lakeweave.sources.tables import materialize

FIELD_SCHEMA = "file_id bigint, field string, parent string, kind string"
#: Characters of paths that one batch holds at most, but for one line's.
BATCH_CHARS = 32_000_000


def load_object(line: str | None) -> dict | None:
    """The JSON object of a log line, of any depth, or None."""
    if not line:
        return None
    try:
        value = jsontext.loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def record_type(record: dict) -> str:
    """The type value a record's paths begin with; without a type it is ''."""
    value = record.get("type")
    return value if isinstance(value, str) else "" if value is None else jsontext.dumps(value)


def fields_of(record: dict) -> Iterator[tuple[str, str, str]]:
    """(path, parent's path, kind) of every value in the record that is not null; paths may come again."""
    stack = [(record_type(record), "", record)]
    while stack:
        path, parent, node = stack.pop()
        kind = kind_of(node)
        if not kind:
            continue
        yield path, parent, kind
        if kind == "object":
            stack += [(f"{path}.{k}", path, v) for k, v in node.items()]
        elif kind == "array":
            stack += [(f"{path}[]", path, v) for v in node]


def field_catalogue(lines: DataFrame) -> DataFrame:
    """(file_id, field, parent, kinds) from (file_id, line).

    Kinds are gathered per batch before the shuffle, so what is shuffled follows
    the number of fields, not of lines. A field is told by its whole path, so a line
    costs the square of its depth, in batches of bounded size.
    """

    def told(seen: set) -> pa.RecordBatch:
        rows = sorted(seen)
        arrays = [pa.array([r[i] for r in rows], pa.string() if i else pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(arrays, names=["file_id", "field", "parent", "kind"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        size = 0
        for file_id, line in zip(batch.column("file_id").to_pylist(), batch.column("line").to_pylist()):
            record = load_object(line)
            if record is None or file_id is None:
                continue
            for f in fields_of(record):
                if (file_id, *f) not in seen:
                    seen.add((file_id, *f))
                    size += len(f[0]) + len(f[1])
                if size > BATCH_CHARS:
                    yield told(seen)
                    seen, size = set(), 0
        yield told(seen)

    found = map_arrow(lines.select("file_id", "line"), run, FIELD_SCHEMA)
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",")
    return found.groupBy("file_id", "field", "parent").agg(kinds.alias("kinds"))


def paths_above(field: Column) -> Column:
    """The hashes of all paths a field lies beneath: its own, cut before every '.' and '[]'."""
    cuts = F.filter(F.sequence(F.lit(2), F.length(field)), lambda i: (F.substring(field, i, 1) == ".") | (F.substring(field, i, 2) == "[]"))
    return F.when(F.length(field) > 1, F.transform(cuts, lambda i: F.xxhash64(F.substring(field, F.lit(1), i - 1))))


def number_files(files: DataFrame, producer: str, time: str) -> DataFrame:
    """(producer, file_id, seq, last_seq): a producer's files by time, from 1."""
    by = W.partitionBy(producer)
    one = files.select(producer, "file_id", time).filter(F.col("file_id").isNotNull()).dropDuplicates(["file_id"])
    return one.select(F.col(producer).alias("producer"), "file_id", F.row_number().over(by.orderBy(time, "file_id")).alias("seq"), F.count("*").over(by).alias("last_seq"))


def lifespans(catalogue: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row per producer, field and kinds and unbroken run of files: where it starts and ends."""
    rows = catalogue.join(numbered, "file_id")
    w = W.partitionBy("producer", "field", "kinds").orderBy("seq")
    rows = rows.withColumn("starts", (F.col("seq") - F.lag("seq").over(w) != 1) | F.lag("seq").over(w).isNull())
    rows = rows.withColumn("island", F.sum(F.col("starts").cast("int")).over(w))
    first, last = F.min_by("file_id", "seq"), F.max_by("file_id", "seq")
    return rows.groupBy("producer", "field", "parent", "kinds", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), first.alias("first_file_id"), last.alias("last_file_id"), F.max("last_seq").alias("n_files"))


def changes(catalogue: DataFrame, numbered: DataFrame) -> DataFrame:
    """(file_id, field, change, new_field, kinds, old_kinds): every file against the one before it."""
    spans = lifespans(catalogue, numbered)
    at = lambda when, seq, side: F.when(when, F.struct(seq.cast("int").alias("seq"), F.lit(side).alias("side")))
    sides = F.array(at(F.col("first_seq") > 1, F.col("first_seq"), 1), at(F.col("last_seq") < F.col("n_files"), F.col("last_seq") + 1, 0))
    told = spans.select("producer", "field", "parent", "kinds", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("e")).select("producer", "field", "parent", "kinds", "e.*")
    # a run that ends where another run of the same field starts has only changed its kinds
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    events = told.groupBy("producer", "seq", "field", "parent").agg(pick(0, "kinds").alias("old_kinds"), pick(1, "kinds").alias("kinds"))
    what = F.when(F.col("old_kinds").isNull(), "added").when(F.col("kinds").isNull(), "removed").otherwise("retyped")
    # what changed is little; it is written once and read by each of the steps below
    events = materialize(events.withColumn("change", what), "drift-events")
    # one gone and one come with the same kinds under one parent: renamed
    pairs = (
        events.filter("change <> 'retyped'")
        .groupBy("producer", "seq", "parent", F.coalesce("kinds", "old_kinds").alias("kinds"))
        .agg(
            F.count_if(F.col("change") == "removed").alias("gone"),
            F.count_if(F.col("change") == "added").alias("come"),
            F.max(F.when(F.col("change") == "removed", F.col("field"))).alias("field"),
            F.max(F.when(F.col("change") == "added", F.col("field"))).alias("new_field"),
        )
        .filter("gone = 1 and come = 1")
    )
    renamed = pairs.select("producer", "seq", "field", "new_field")
    come = renamed.select("producer", "seq", F.col("new_field").alias("field"), F.lit(True).alias("is_new_name"))
    listed = events.join(renamed, ["producer", "seq", "field"], "left").join(come, ["producer", "seq", "field"], "left")
    listed = listed.filter("is_new_name is null").withColumn("change", F.when(F.col("new_field").isNotNull(), "renamed").otherwise(F.col("change")))
    # nothing beneath a changed field is told again
    beneath = listed.select("producer", "seq", "field", F.explode(paths_above(F.col("field"))).alias("above"))
    changed = events.select("producer", "seq", F.xxhash64("field").alias("above"))
    hidden = beneath.join(changed, ["producer", "seq", "above"], "left_semi").select("producer", "seq", "field").distinct()
    top = listed.join(hidden, ["producer", "seq", "field"], "left_anti")
    return top.join(numbered, ["producer", "seq"]).select("producer", "file_id", "field", "change", F.coalesce("new_field", F.lit("")).alias("new_field"), "old_kinds", "kinds")


def _pieces(path: str) -> list[str]:
    """A field's path cut before every '.' and '[]'."""
    ends = [m.start() for m in re.finditer(r"\.|\[\]", path)]
    return [path[i:j] for i, j in zip([0, *ends], [*ends, len(path)])]


def canonical_name(path: str, names: dict[str, str]) -> str:
    """The path with every renamed field on it, itself or one above it, under its canonical name."""
    out = ""
    for piece in _pieces(path):
        out = names.get(out + piece, out + piece)
    return out


def canonical_names(renames: Iterable[tuple[str, str, int]]) -> dict[str, str]:
    """name -> canonical from (old, new, how often): names joined by renames, directly or not, are one field.

    Fields above come first, so that a rename told beneath an old name counts beneath the
    canonical one. Of one field's names the one that more files came to than left wins,
    of equal ones the greatest.
    """
    names: dict[str, str] = {}
    levels: dict[int, list[tuple[str, str, int]]] = {}
    for old, new, n in renames:
        levels.setdefault(len(_pieces(old)), []).append((old, new, n))
    for level in sorted(levels):
        above = dict(names)
        score: dict[str, int] = {}
        group: dict[str, set[str]] = {}
        for old, new, n in levels[level]:
            a, b = canonical_name(old, above), canonical_name(new, above)
            for name, came in ((a, -n), (b, n)):
                score[name] = score.get(name, 0) + came
                group.setdefault(name, {name})
            if group[a] is not group[b]:
                less, more = sorted((group[a], group[b]), key=len)
                more |= less
                group.update(dict.fromkeys(less, more))
        best = {id(g): max(g, key=lambda x: (score[x], x)) for g in group.values()}
        names.update({x: best[id(g)] for x, g in group.items() if x != best[id(g)]})
    return names


def _names(aliases: DataFrame) -> dict[str, str]:
    """An alias table as a map; it follows the number of renamed fields, not of records."""
    return canonical_names(sorted((r[0], r[1], 1) for r in aliases.select("field", "canonical").collect()))


def _with_canonical(df: DataFrame, field: str, aliases: DataFrame) -> DataFrame:
    """``df`` with the canonical name of the field's path beside it."""
    names = _names(aliases)
    if not names:
        return df.withColumn("canonical", F.col(field))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths = batch.column(field).dictionary_encode()
        new = pa.array([canonical_name(p, names) for p in paths.dictionary.to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, new.take(paths.indices)], names=[*batch.schema.names, "canonical"])

    return map_arrow(df, run, T.StructType([*df.schema, T.StructField("canonical", T.StringType())]))


def alias_table(log: DataFrame) -> DataFrame:
    """Every renamed field and the name it has in the unified table: one each, whatever lay between.

    The newest name wins: of the names of one field, the one that more files came to.
    """
    told = log.filter("change = 'renamed'").groupBy("field", "new_field").count().collect()
    names = canonical_names(sorted(tuple(r) for r in told))
    names |= {x: canonical_name(x, names) for r in told for x in r[:2]}
    return log.sparkSession.createDataFrame(sorted((a, b) for a, b in names.items() if a != b), "field string, canonical string")


def cast_table(catalogue: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per field of the unified table: the names it had, all kinds seen, and the type it is read as.

    One kind keeps its type; number and string give string; any mix with an object
    or array is kept as JSON text, so no value is lost.
    """
    named = _with_canonical(catalogue, "field", aliases)
    kind = F.explode(F.split("kinds", ","))
    seen = named.select("canonical", "field", "file_id", kind.alias("kind"))
    out = seen.groupBy("canonical").agg(F.array_sort(F.collect_set("field")).alias("names"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_distinct("file_id").alias("n_files"))
    one = F.size("kinds") == 1
    target = (
        F.when(one & (F.col("kinds")[0] == "number"), "double")
        .when(one & (F.col("kinds")[0] == "boolean"), "boolean")
        .when(~F.array_contains("kinds", "object") & ~F.array_contains("kinds", "array"), "string")
        .otherwise("json")
    )
    return out.select(F.col("canonical").alias("field"), F.array_join("names", ",").alias("names"), F.array_join("kinds", ",").alias("kinds"), target.alias("read_as"), "n_files")


VALUE_SCHEMA = "file_id bigint, record_index int, record_type string, field string, kind string, value string"


def mixed_fields(catalogue: DataFrame, aliases: DataFrame) -> frozenset[str]:
    """Paths, under the names they had, of objects and arrays whose field has other kinds too."""
    seen = _with_canonical(catalogue, "field", aliases).select("canonical", "field", F.explode(F.split("kinds", ",")).alias("kind"))
    fields = seen.groupBy("canonical").agg(F.count_distinct("kind").alias("n"), F.collect_set(F.when(F.col("kind").isin("object", "array"), F.col("field"))).alias("fields"))
    return frozenset(r[0] for r in fields.filter("n > 1").select(F.explode("fields")).collect())


def record_values(lines: DataFrame, whole: frozenset[str] = frozenset()) -> DataFrame:
    """Every scalar value of every record: (file_id, record_index, record_type, field, kind, value).

    Array elements keep their positions in the path (``a.list[2].b``). Objects and arrays at the
    paths ``whole`` (``a.list[]``) are values too, as JSON text, beside the values in them.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for file_id, index, line in zip(*(batch.column(c).to_pylist() for c in ("file_id", "record_index", "line"))):
            record = load_object(line)
            if record is None:
                continue
            top = record_type(record)
            stack = [(top, record)]
            while stack:
                path, node = stack.pop()
                kind = kind_of(node)
                if whole and kind in ("object", "array") and node and re.sub(r"\[\d+\]", "[]", path) in whole:
                    for c, v in zip(cols, (file_id, index, top, path, kind, jsontext.dumps(node))):
                        c.append(v)
                if kind == "object" and node:
                    stack += [(f"{path}.{k}", v) for k, v in reversed(node.items())]
                elif kind == "array" and node:
                    stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]
                elif kind:
                    for c, v in zip(cols, (file_id, index, top, path, kind, node if kind == "string" else jsontext.dumps(node))):
                        c.append(v)
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file_id", "record_index", "record_type", "field", "kind", "value"])

    once = lines.select("file_id", "record_index", "line").dropDuplicates(["file_id", "record_index", "line"])
    return map_arrow(once, run, VALUE_SCHEMA)


def unify(values: DataFrame, aliases: DataFrame, casts: DataFrame | None = None) -> DataFrame:
    """The values under one name each: renamed fields take the canonical name, the old one stays beside it.

    A field beneath a renamed one is named with it. With a cast table each value comes in its
    field's type: a number in ``as_double``, a boolean in ``as_boolean``, and ``value`` is the
    text of a string or number as it is, or JSON text where ``read_as`` is json.
    """
    plain: Column = F.regexp_replace("field", r"\[\d+\]", "[]")
    rows = _with_canonical(values.withColumn("plain", plain), "plain", aliases)
    rows = rows.select("file_id", "record_index", "record_type", F.col("canonical").alias("field"), F.col("field").alias("source_path"), "kind", "value")
    if casts is None:
        return rows
    rows = rows.join(casts.select("field", "read_as"), "field", "left")
    # a string as JSON text: the only element of a list, without its brackets
    quoted = F.regexp_replace(F.to_json(F.array("value")), r"(?s)^\[(.*)\]$", "$1")
    text = F.when((F.col("read_as") == "json") & (F.col("kind") == "string"), quoted).otherwise(F.col("value"))
    typed = lambda name, kind: F.when(F.col("read_as") == name, F.col("value").try_cast(kind))
    return rows.select("file_id", "record_index", "record_type", "field", "source_path", "kind", text.alias("value"), "read_as", typed("double", T.DoubleType()).alias("as_double"), typed("boolean", T.BooleanType()).alias("as_boolean"))
