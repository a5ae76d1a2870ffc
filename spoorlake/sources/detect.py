"""Format detection of imported files, and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsonl import lines


def _path(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def json_format(value: Column) -> Column:
    """The format of one JSON document: message graph, chat list, activity records, API response or chunk, session
    header, messages, one message, else ``json``. Shape predicates over a variant; the first that fits wins."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    array = kind.startswith("ARRAY")
    at = lambda p: F.coalesce(_path(v, "$[0]" + p), _path(v, "$" + p))
    has = lambda p: F.coalesce(_path(v, "$[0]" + p, "variant"), _path(v, "$" + p, "variant")).isNotNull()
    activity = has(".products") & has(".time") & (has(".title") | has(".description") | has(".header"))
    return (
        F.when(v.isNull(), F.lit(None))
        .when(has(".mapping"), "message_graph_export")
        .when(has(".chat_messages") & at(".uuid").isNotNull(), "chat_list_export")
        .when(activity, "activity_takeout")
        .when(has(".choices") & (at(".object") == "chat.completion.chunk"), "completion_chunk")
        .when(has(".choices"), "completion")
        .when(has(".first_live_seq") | has(".session_header"), "harness_session")
        .when(has(".messages"), "messages")
        .when(has(".role"), "message")
        .when(array | kind.startswith("OBJECT"), "json")
    )


def detect(files: DataFrame) -> DataFrame:
    """``path, format, basis, records`` of ``path, content``: ZIP magic is rejected; several lines that are JSON each,
    then a whole JSON document, then HTML, else text."""
    whole = files.withColumn("w", json_format(F.col("content")))
    per_line = lines(files).withColumn("f", json_format(F.col("value"))).groupBy("path").agg(F.count("*").alias("n"), F.count("f").alias("good"), F.min_by("f", "line").alias("lf"))
    both = whole.join(per_line, "path", "left")
    zipped, html = F.startswith("content", F.lit("PK\x03\x04")), F.col("content").rlike(r"(?is)<(!doctype html|html|body)\b")
    as_lines = (F.col("n") > 1) & (F.col("good") == F.col("n"))  # the parser stops after a first document
    name = F.when(zipped, "rejected_zip").when(as_lines, F.concat(F.col("lf"), F.lit("_jsonl"))).when(F.col("w").isNotNull(), F.col("w")).when(html, "html").otherwise("text")
    basis = F.when(zipped, "magic").when(as_lines, "lines").when(F.col("w").isNotNull(), "document").when(html, "markup").otherwise("none")
    records = F.when(as_lines, F.col("n")).when(F.col("w").isNotNull(), 1).otherwise(0).cast("long")
    return both.select("path", name.alias("format"), basis.alias("basis"), records.alias("records"))


_MESSAGE = "conversation string, message_id string, parent_id string, role string, text string, created string, seq double"


def graph_messages(docs: DataFrame) -> DataFrame:
    """Messages of graph exports (``path, value``): nodes of ``mapping``; a parent node id becomes its message id."""
    v = F.try_parse_json("value")
    rows = docs.select("path", v.alias("v"))
    one = rows.select("path", F.try_variant_get("v", "$.mapping", "map<string, variant>").alias("m"), F.try_variant_get("v", "$", "array<variant>").alias("a"))
    each = one.select("path", F.posexplode(F.when(F.col("a").isNotNull(), F.transform("a", lambda x: F.try_variant_get(x, "$.mapping", "map<string, variant>"))).otherwise(F.array("m"))).alias("i", "m"))
    nodes = each.select("path", "i", F.explode("m").alias("node", "x"))
    get = lambda p, k="string": F.try_variant_get("x", p, k)
    nodes = nodes.where(get("$.message", "variant").isNotNull()).select(
        F.concat_ws("#", "path", F.col("i").cast("string")).alias("conversation"), "node", F.coalesce(get("$.message.id"), F.col("node")).alias("message_id"), get("$.parent").alias("parent"),
        F.coalesce(get("$.message.author.role"), F.lit("unknown")).alias("role"), F.array_join(get("$.message.content.parts", "array<string>"), "\n").alias("text"), get("$.message.create_time").alias("created"), get("$.message.create_time", "double").alias("seq"),
    )
    ids = nodes.select("conversation", F.col("node").alias("parent"), F.col("message_id").alias("p"))
    return nodes.join(ids, ["conversation", "parent"], "left").select("conversation", "message_id", F.coalesce("p", "parent").alias("parent_id"), "role", "text", "created", "seq")


def list_messages(docs: DataFrame) -> DataFrame:
    """Messages of chat-list exports and plain ``messages`` documents."""
    v = F.try_parse_json("value")
    chats = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(F.try_variant_get(v, "$", "variant")))
    rows = docs.select("path", F.posexplode(chats).alias("i", "c"))
    messages = F.coalesce(F.try_variant_get("c", "$.chat_messages", "array<variant>"), F.try_variant_get("c", "$.messages", "array<variant>"))
    rows = rows.select(F.concat_ws("#", "path", F.col("i").cast("string")).alias("conversation"), F.posexplode(messages).alias("j", "x"))
    first = lambda *names: F.coalesce(*[F.try_variant_get("x", "$." + n, "string") for n in names])
    return rows.select(
        "conversation", F.coalesce(first("uuid", "id", "message_id"), F.col("j").cast("string")).alias("message_id"), first("parent_id", "parentId", "parent_message_id").alias("parent_id"),
        F.coalesce(first("sender", "role"), F.lit("unknown")).alias("role"), first("text", "content").alias("text"), first("created_at", "timestamp", "updated_at").alias("created"), F.col("j").cast("double").alias("seq"),
    )


def activity_messages(docs: DataFrame, product: str = r"(?i)^gemini\s+apps$") -> DataFrame:
    """Prompts (``Prompted ...`` titles) and other activity of takeout records."""
    v = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(F.try_variant_get(v, "$", "variant")))
    rows = docs.select("path", F.posexplode(items).alias("i", "x"))
    get = lambda p, k="string": F.try_variant_get("x", p, k)
    rows = rows.where(F.exists(get("$.products", "array<string>"), lambda p: F.trim(p).rlike(product)) & get("$.time").isNotNull())
    title = F.trim(F.coalesce(get("$.title"), F.lit("")))
    prompt = F.trim(F.regexp_extract(title, r"(?is)^prompted\s+(.+)$", 1))
    details = F.array_join(F.filter(F.array(F.trim(get("$.description")), F.trim(get("$.details"))), lambda d: d.isNotNull() & (d != "")), "\n")
    parts = F.array(
        F.when(prompt != "", F.struct(F.lit("user").alias("role"), prompt.alias("text"))).when(title != "", F.struct(F.lit("environment").alias("role"), title.alias("text"))),
        F.when(details != "", F.struct(F.lit("environment").alias("role"), details.alias("text"))),
    )
    rows = rows.select("path", "i", get("$.time").alias("created"), F.posexplode(F.filter(parts, lambda p: p.isNotNull())).alias("j", "p"))
    name = F.concat_ws(":", F.col("i").cast("string"), F.col("j").cast("string"))
    return rows.select(F.col("path").alias("conversation"), name.alias("message_id"), F.lit(None).cast("string").alias("parent_id"), "p.role", "p.text", "created", F.col("j").cast("double").alias("seq"))


def completion_messages(docs: DataFrame) -> DataFrame:
    """Messages of completion responses and chunks (``path, value``): text, reasoning, tool calls and usage."""
    v = F.try_parse_json("value")
    rows = docs.select("path", v.alias("v")).select("path", "v", F.explode_outer(F.try_variant_get("v", "$.choices", "array<variant>")).alias("c"))
    body = lambda p: F.coalesce(F.try_variant_get("c", "$.message." + p, "string"), F.try_variant_get("c", "$.delta." + p, "string"))
    calls = F.coalesce(F.try_variant_get("c", "$.message.tool_calls", "array<variant>"), F.try_variant_get("c", "$.delta.tool_calls", "array<variant>"))
    get = lambda p, k: F.try_variant_get("v", p, k)
    return rows.select(
        "path", get("$.id", "string").alias("response_id"), get("$.model", "string").alias("model"), F.try_variant_get("c", "$.index", "int").alias("choice"), body("content").alias("text"), body("reasoning_content").alias("reasoning"),
        F.transform(calls, lambda t: F.struct(F.try_variant_get(t, "$.id", "string").alias("id"), F.try_variant_get(t, "$.function.name", "string").alias("name"), F.try_variant_get(t, "$.function.arguments", "string").alias("arguments"))).alias("tool_calls"),
        get("$.usage.prompt_tokens", "long").alias("input_tokens"), get("$.usage.completion_tokens", "long").alias("output_tokens"),
    )


def session_of(value: Column) -> Column:
    """The first of conversation_id, uuid, id, session_id."""
    v = F.try_parse_json(value)
    return F.coalesce(*[F.try_variant_get(v, "$." + k, "string") for k in "conversation_id uuid id session_id".split()])
