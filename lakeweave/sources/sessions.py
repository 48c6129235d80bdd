"""Readers and writers of session logs, chat histories and payloads.

Log lines are read as text and parsed leniently: a line that is cut gives no rows and can
be counted; it never fails a file. Schemas are stated, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def log_events(lines: DataFrame) -> DataFrame:
    """(file_id, record_index, part, kind, role, call_id, tool, text, input_tokens, output_tokens) of both dialects.

    kind is message, call, result, usage or boundary. A message with several parts gives one
    row each; records of other types give none.
    """
    rows = lines.select("file_id", "record_index", "line").dropDuplicates(["file_id", "record_index", "line"])
    v = F.try_parse_json("line")
    rows = rows.select("file_id", "record_index", v.alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    rows = rows.withColumn("type", _get(F.col("v"), "$.type"))
    c = F.col("v")
    null = F.lit(None).cast("string")

    def out(kind, role=null, call=null, tool=null, text=null, i=F.lit(None), o=F.lit(None), part=F.lit(0)):  # noqa: B008
        return F.struct(part.cast("int").alias("part"), kind.alias("kind"), role.alias("role"), call.alias("call_id"), tool.alias("tool"), text.alias("text"), i.cast("bigint").alias("input_tokens"), o.cast("bigint").alias("output_tokens"))

    # dialect 1: messages whose content is a text or a list of parts
    content = "$.message.content"
    parts = _get(c, content, "array<variant>")
    p_type = lambda p: _get(p, "$.type")
    part_kind = lambda p: F.when(p_type(p) == "tool_use", "call").when(p_type(p) == "tool_result", "result").when(p_type(p) == "text", "message")
    role1 = _get(c, "$.message.role")
    from_list = F.transform(parts, lambda p, i: out(part_kind(p), role1, F.coalesce(_get(p, "$.id"), _get(p, "$.tool_use_id")), _get(p, "$.name"), F.coalesce(_get(p, "$.text"), _get(p, "$.content")), part=i))
    plain = F.array(out(F.lit("message"), role1, text=_get(c, content)))
    is_list = F.schema_of_variant(_get(c, content, "variant")).startswith("ARRAY")
    usage1 = out(F.lit("usage"), i=_get(c, "$.message.usage.input_tokens", "bigint"), o=_get(c, "$.message.usage.output_tokens", "bigint"), part=F.lit(1000))
    first = F.when(is_list, from_list).otherwise(plain)
    first = F.when(_get(c, "$.message.usage", "variant").isNotNull(), F.array_append(first, usage1)).otherwise(first)
    # dialect 2: items with one payload
    # a text may stand as such, as parts with a text each, or as an object's content
    def said(path: str) -> Column:
        parts = F.array_join(F.transform(_get(c, path, "array<variant>"), lambda x: _get(x, "$.text")), "\n")
        kind = F.schema_of_variant(_get(c, path, "variant"))
        return F.when(kind.startswith("ARRAY"), parts).when(kind.startswith("OBJECT"), _get(c, path + ".content")).otherwise(_get(c, path))

    p = "$.payload."
    t2 = _get(c, p + "type")
    call_id = F.coalesce(_get(c, p + "call_id"), _get(c, p + "id"))
    item = (
        F.when(t2 == "message", out(F.lit("message"), _get(c, p + "role"), text=said(p + "content")))
        .when(t2.isin("function_call", "custom_tool_call", "local_shell_call", "web_search_call"), out(F.lit("call"), F.lit("assistant"), call_id, _get(c, p + "name"), F.coalesce(_get(c, p + "arguments"), _get(c, p + "input"))))
        .when(t2.isin("function_call_output", "custom_tool_call_output"), out(F.lit("result"), F.lit("user"), call_id, text=said(p + "output")))
    )
    usage2 = out(F.lit("usage"), i=_get(c, p + "info.last_token_usage.input_tokens", "bigint"), o=_get(c, p + "info.last_token_usage.output_tokens", "bigint"))
    events = (
        F.when(F.col("type").isin("user", "assistant"), first)
        .when(F.col("type") == "response_item", F.array(item))
        .when((F.col("type") == "event_msg") & (t2 == "token_count"), F.array(usage2))
        .when((F.col("type") == "compacted") | (_get(c, "$.subtype") == "compact_boundary"), F.array(out(F.lit("boundary"))))
    )
    return rows.select("file_id", "record_index", F.explode(events).alias("e")).select("file_id", "record_index", "e.*").filter("kind is not null")


def chat_history(lines: DataFrame) -> DataFrame:
    """(file, message, role, text) of chat-history Markdown, given as (file, line_no, line).

    ``# `` lines are skipped, ``#### `` lines are the user's, ``> `` lines the tools', all
    others the assistant's; unbroken runs of one role are a message, blank ones are left out.
    """
    c = F.col("line")
    rows = lines.filter(~c.startswith("# "))
    role = F.when(c.startswith("#### "), "user").when(c.startswith("> "), "tool").otherwise("assistant")
    body = F.when(c.startswith("#### "), F.substring(c, 6, 1 << 30)).when(c.startswith("> "), F.substring(c, 3, 1 << 30)).otherwise(c)
    w = W.partitionBy("file").orderBy("line_no")
    rows = rows.select("file", "line_no", role.alias("role"), body.alias("body"))
    rows = rows.withColumn("new", F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), "\n")
    m = rows.groupBy("file", "run", "role").agg(text.alias("text")).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return m.select("file", F.row_number().over(W.partitionBy("file").orderBy("run")).alias("message"), "role", "text")


def _items(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, t) for k, t in fields.items()]))


_S, _B = T.StringType(), T.BooleanType()
#: A message of a payload, with the other spellings of its members.
PAYLOAD_ITEM = T.StructType(
    [
        T.StructField("role", _S),
        T.StructField("text", _S),
        T.StructField("toolUses", _items(tool_use_id=_S, tool=_S, input=_S)),
        T.StructField("toolResults", _items(tool_use_id=_S, text=_S, is_error=_B)),
        T.StructField("tool_calls", _items(id=_S, name=_S, input=_S)),
        T.StructField("tool_results", _items(tool_call_id=_S, text=_S, is_error=_B)),
    ]
)


def payload_rows(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, message_index, item): every message of a payload as JSON text, one row each."""
    t = transcripts.dropDuplicates(["transcript_id"]).select("transcript_id", F.posexplode("payload").alias("message_index", "item"))
    return t.select("transcript_id", "message_index", F.to_json("item").alias("item"))


def parse_payload(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`payload_rows`, and of other spellings of the same members."""
    p = rows.select("transcript_id", "message_index", F.from_json("item", PAYLOAD_ITEM).alias("m"))
    uses = F.coalesce("m.toolUses", F.transform("m.tool_calls", lambda u: F.struct(u["id"].alias("tool_use_id"), u["name"].alias("tool"), u["input"].alias("input"))))
    results = F.coalesce("m.toolResults", F.transform("m.tool_results", lambda r: F.struct(r["tool_call_id"].alias("tool_use_id"), r["text"].alias("text"), r["is_error"].alias("is_error"))))
    return p.select("transcript_id", "message_index", "m.role", "m.text", uses.alias("toolUses"), results.alias("toolResults"))


def toon(df: DataFrame, name: str, group: str) -> DataFrame:
    """(group, toon): a group's rows as a compact table: ``name[n]{a,b}:`` and a line of values each.

    A value with a comma, quote, line end or outer blank is quoted; null is an empty value.
    Groups are gathered, so this is for groups of bounded size (a document's chunks, a report).
    """
    cols = [c for c in df.columns if c != group]

    def cell(c: str) -> Column:
        s = F.col(c).cast("string")
        odd = s.rlike(r'[,"\n\r]|^\s|\s$') | (s == "")
        return F.coalesce(F.when(odd, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(s), F.lit(""))

    rows = df.select(group, F.concat_ws(",", *[cell(c) for c in cols]).alias("row"), F.struct(*cols).alias("order"))
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("order", "row"))).alias("rows"))
    head = F.concat(F.lit(f"{name}["), F.size("rows").cast("string"), F.lit("]{" + ",".join(cols) + "}:"))
    return g.select(group, F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("toon"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines by a stated schema; ``_bad`` holds a line that is none, so it can be counted."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
