"""Normalisers: raw payloads (one JSON document a row) to canonical events, one projection per adapter.

A payload stays a VARIANT; each adapter explodes its blocks or items and maps their kinds by CASE. Ids are digests, so
the same payload always gives the same events. Unknown kinds become partial inferences without content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_id

#: Alias lists of usage fields; the first finite, non-negative number counts.
USAGE = {
    "input_tokens": ("input_tokens", "inputTokens", "prompt_tokens", "promptTokenCount"), "output_tokens": ("output_tokens", "outputTokens", "completion_tokens", "candidatesTokenCount"),
    "reasoning_tokens": ("reasoning_tokens", "reasoningTokens", "thoughtsTokenCount"), "cache_read_tokens": tuple("cache_read_input_tokens cache_read_tokens cacheReadTokens cached_input_tokens cachedContentTokenCount".split()),
    "latency_ms": tuple("latency_ms duration_ms durationMs".split()), "cost_usd": tuple("cost_usd total_cost_usd costUsd".split()),
}


def get(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first path that has a value of the kind."""
    return F.coalesce(*[F.try_variant_get(v, "$." + p, kind) for p in paths])


def usage(v: Column, prefix: str = "usage") -> dict[str, Column]:
    ok = lambda x: F.when((x >= 0) & (x < float("inf")), x)
    return {name: F.coalesce(*[ok(F.try_variant_get(v, f"$.{prefix}.{a}", "double")) for a in aliases]) for name, aliases in USAGE.items()}


def instant(v: Column, *paths: str) -> Column:
    """Numbers from 1e11 on are milliseconds, smaller ones seconds; strings are parsed; else null."""
    n = get(v, *paths, kind="double")
    number = F.when(n >= 1e11, F.timestamp_millis(n.cast("long"))).otherwise(F.timestamp_millis((n * 1000).cast("long")))
    return F.coalesce(F.when(n.isNotNull(), number), F.try_to_timestamp(get(v, *paths)))


def raw_envelopes(lines: DataFrame, adapter: str, interface: str) -> DataFrame:
    """Raw rows of ``path, line, value``; the stored order is the append order."""
    v = F.try_parse_json("value")
    rows = lines.withColumn("v", v)
    at = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return rows.select(
        "path", F.lit(adapter).alias("adapter"), F.lit(interface).alias("interface_version"), instant(F.col("v"), "timestamp", "created_at", "createdAt").alias("captured_at"), at.cast("long").alias("sequence"),
        get(F.col("v"), "event_id", "eventId", "id").alias("source_event_id"), get(F.col("v"), *"session_id sessionId thread_id threadId".split()).alias("session_id"), get(F.col("v"), "turn_id", "turnId").alias("turn_id"),
        F.sha2("value", 256).alias("payload_sha256"), F.col("value").alias("payload"), F.col("v"),
    )


def event_rows(rows: DataFrame, index: Column) -> DataFrame:
    """Ids, order and defaults of events from rows that have the raw columns and the mapped ones."""
    key = F.coalesce("event_key", "source_event_id", "payload_sha256")
    rows = rows.withColumns({"_key": key, "_index": index})
    span = stable_id(F.col("adapter"), F.col("_key"), F.col("event_type"), F.col("_index").cast("string"), length=16)
    session = F.coalesce("session_id", "payload_sha256")
    out = rows.where("event_type IS NOT NULL").select(
        stable_id(session, length=32).alias("trace_id"), F.concat_ws(":", "adapter", "_key", "event_type", F.col("_index").cast("string")).alias("event_id"), span.alias("span_id"), F.col("parent_span_id"),
        F.col("captured_at").alias("started_at"), F.when(F.col("status") != "partial", F.col("captured_at")).alias("ended_at"), "event_type", "actor", "status", F.coalesce("event_key", "source_event_id").alias("source_event_id"),
        "session_id", "turn_id", "step_id", F.when(F.col("text").isNotNull(), F.array(F.struct(F.lit(0).alias("ordinal"), F.col("part").alias("type"), F.col("text").alias("value")))).otherwise(F.array().cast("array<struct<ordinal: int, type: string, value: string>>")).alias("content"),
        "call_id", "tool_name", "exit_code", *USAGE, F.lit("include").alias("review_disposition"), "path", F.col("sequence").alias("_raw"), "_index",
    )
    order = F.row_number().over(Window.partitionBy("path").orderBy("_raw", "_index")) - 1
    return out.withColumn("sequence", order.cast("long")).drop("_raw", "_index")


def _mapped(rows: DataFrame, **columns: Column) -> DataFrame:
    empty = {c: F.lit(None).cast("string") for c in ("event_key", "parent_span_id", "step_id", "call_id", "tool_name", "text")}
    base = {**empty, "exit_code": F.lit(None).cast("int"), "part": F.lit("text"), "status": F.lit("ok"), **{u: F.lit(None).cast("double") for u in USAGE}}
    return rows.withColumns({k: v for k, v in base.items() if k not in columns} | columns)


def _case(on: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(on == k, v) if out is None else out.when(on == k, v)
    return out.otherwise(F.lit(default))


def message_stream(raw: DataFrame) -> DataFrame:
    """Streams of assistant and user messages with content blocks, deltas (partial) and a final result."""
    v = F.col("v")
    raw = raw.withColumns({"kind": get(v, "type"), "session_id": F.last("session_id", True).over(Window.partitionBy("path").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))})
    text_block = F.array(F.to_variant_object(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), get(v, "message.content"))))
    blocks = raw.where("kind IN ('assistant', 'user')").select("*", F.posexplode(F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), text_block)).alias("i", "b"))
    b, block, mine = F.col("b"), get(F.col("b"), "type"), F.col("kind") == "assistant"
    first = F.col("i") == 0
    spent = {k: F.when(first & mine, x) for k, x in usage(v, "message.usage").items()}
    kind = F.when(mine, _case(block, {"text": "message", "thinking": "reasoning", "redacted_thinking": "reasoning", "tool_use": "tool.call"}, "model.inference")).when(block == "tool_result", "tool.result").when(get(b, "text", "content").isNotNull(), "message")
    shown = F.when(block == "thinking", get(b, "thinking", "text", "summary")).when(block == "tool_use", F.to_json(F.try_variant_get(b, "$.input", "variant"))).when(block == "tool_result", F.coalesce(get(b, "content"), F.to_json(F.try_variant_get(b, "$.content", "variant")))).when(block == "text", get(b, "text", "content"))
    status = F.when(mine & (kind == "model.inference"), "partial").when(F.try_variant_get(b, "$.is_error", "boolean"), "error").otherwise("ok")
    one = _mapped(
        blocks, event_key=get(v, "message.id", "uuid"), event_type=kind, actor=F.when(mine, "assistant").when(block == "tool_result", "tool").otherwise("user"), status=status, text=shown,
        part=_case(block, {"thinking": "reasoning", "tool_use": "tool_call", "tool_result": "tool_result"}, "text"), call_id=F.when(block.isin("tool_use", "tool_result"), get(b, "id", "tool_use_id", "call_id")), tool_name=get(b, "name", "tool_name"), **spent,
    )
    rest = raw.where("kind IN ('stream_event', 'result')").withColumns({"i": F.lit(0), "b": v})
    failed = F.coalesce(F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False)) | get(v, "subtype").startswith("error")
    done = F.col("kind") == "result"
    two = _mapped(
        rest, event_type=F.when(done & failed, "error").when(done, "evaluation").otherwise("model.inference"), actor=F.when(done, "system").otherwise("assistant"), status=F.when(done & failed, "error").when(done, "ok").otherwise("partial"),
        text=F.coalesce(get(v, "event.delta.text", "event.delta.thinking"), get(v, "result")), **{k: F.when(done, x) for k, x in usage(v).items()},
    )
    return event_rows(one.unionByName(two), F.col("i"))


def item_stream(raw: DataFrame) -> DataFrame:
    """Item life-cycle streams: messages, reasoning summaries, commands, file changes, searches, plans, turns, errors."""
    v = F.col("v")
    w = Window.partitionBy("path").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    raw = raw.withColumns({"session_id": F.last("session_id", True).over(w), "turn_id": F.last("turn_id", True).over(w), "life": get(v, "type"), "item": get(v, "item.type")})
    done = F.col("life").isin("item.completed", "item.failed")
    code = F.try_variant_get(v, "$.item.exit_code", "int")
    said = get(v, "item.status")
    status = (
        F.when(code != 0, "error").when(said.isin("failed", "error"), "error").when(said.isin("cancelled", "canceled", "aborted", "interrupted", "declined"), "cancelled")
        .when(said.isin("in_progress", "inProgress", "running", "started"), "partial").when(F.col("life").isin("turn.failed", "error"), "error").otherwise("ok")
    )
    tool = F.col("item").isin("command_execution", "mcp_tool_call")
    kind = (
        F.when(tool, F.when(done, "tool.result").otherwise("tool.call")).when(F.col("item").isNotNull(), _case(F.col("item"), {"agent_message": "message", "reasoning": "reasoning", "file_change": "artifact.patch", "web_search": "retrieval", "todo_list": "plan", "error": "error"}, "model.inference"))
        .otherwise(_case(F.col("life"), {"turn.completed": "model.inference", "turn.failed": "error", "error": "error"}))
    )
    text = F.coalesce(F.when(tool & done, get(v, "item.aggregated_output", "item.output", "item.stderr")).when(tool, get(v, "item.command")), F.when(~tool, get(v, "item.text", "item.message", "item.query")), F.array_join(F.transform(F.try_variant_get(v, "$.item.summary", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), "\n"), F.when(F.col("item").isNull(), get(v, "error.message", "message")))
    rows = _mapped(
        raw, event_key=F.coalesce(get(v, "event_id"), get(v, "item.id")), event_type=kind, actor=F.when(tool & done, "tool").when(F.col("item").isNotNull(), "assistant").otherwise("system"), status=status, text=text,
        part=F.when(tool & done, "stdout").when(tool, "tool_call").when(F.col("item") == "reasoning", "reasoning").when(F.col("item") == "file_change", "patch").otherwise("text"),
        call_id=F.when(tool, get(v, "item.id", "item.call_id")), tool_name=F.when(tool, F.coalesce(get(v, "item.tool", "item.name"), F.col("item"))), exit_code=code, **usage(v),
    )
    return event_rows(rows, F.lit(0))


HOOKS = {
    "SessionStart": ("model.inference", "system"), "UserPromptSubmit": ("message", "user"), "PreToolUse": ("tool.call", "assistant"), "PostToolUse": ("tool.result", "tool"), "PermissionRequest": ("approval.request", "assistant"),
    "PermissionDenied": ("approval.decision", "user"), "SubagentStart": ("agent.invoke", "assistant"), "SubagentStop": ("handoff", "agent"), "PreCompact": ("compaction", "system"), "PostCompact": ("compaction", "system"),
    "Stop": ("evaluation", "system"), "BeforeAgent": ("message", "user"), "AfterAgent": ("message", "assistant"), "BeforeModel": ("model.inference", "system"), "AfterModel": ("model.inference", "assistant"),
    "BeforeTool": ("tool.call", "assistant"), "AfterTool": ("tool.result", "tool"), "Notification": ("feedback", "system"), "PreCompress": ("compaction", "system"), "SessionEnd": ("evaluation", "system"),
}


def hook_stream(raw: DataFrame) -> DataFrame:
    """Hook events by name. A tool event without a call id gets one from session, tool and input."""
    v = F.col("v")
    name = get(v, "hook_event_name")
    made = F.concat(F.lit("synthetic:"), stable_id(F.col("session_id"), get(v, "tool_name"), F.to_json(F.try_variant_get(v, "$.tool_input", "variant")), length=24))
    kind = _case(name, {k: e for k, (e, _) in HOOKS.items()})
    tool = kind.isin("tool.call", "tool.result")
    denied = name.isin("PermissionDenied") | get(v, "decision").isin("deny", "denied", "block")
    failed = F.try_variant_get(v, "$.tool_response.error", "variant").isNotNull() | (get(v, "status") == "error")
    rows = _mapped(
        raw, event_type=kind, actor=_case(name, {k: a for k, (_, a) in HOOKS.items()}), status=F.when(denied, "cancelled").when(failed, "error").otherwise("ok"),
        text=F.coalesce(get(v, "prompt", "prompt_response", "last_assistant_message", "message"), F.when(kind == "tool.call", F.to_json(F.try_variant_get(v, "$.tool_input", "variant"))), F.when(kind == "tool.result", F.coalesce(get(v, "tool_response"), F.to_json(F.try_variant_get(v, "$.tool_response", "variant"))))),
        part=F.when(kind == "tool.call", "tool_call").when(kind == "tool.result", "tool_result").otherwise("text"), call_id=F.when(tool, F.coalesce(get(v, "tool_use_id"), made)), tool_name=get(v, "tool_name"), step_id=get(v, "agent_id"), **usage(v, "llm_response.usageMetadata"),
    )
    events = event_rows(rows, F.lit(0))
    return events.withColumn("review_disposition", F.when(F.col("event_id").rlike(":model\\.inference:") & F.col("content").isNotNull() & (F.size("content") > 0), "exclude").otherwise("include"))


DURABLE = {
    "session/start": "model.inference", "request/header": "model.inference", "message/user": "message", "message/assistant": "message", "reasoning": "reasoning", "tool/call": "tool.call", "tool/result": "tool.result", "usage": "model.inference",
    "plan": "plan", "approval/request": "approval.request", "approval/decision": "approval.decision", "subagent/start": "agent.invoke", "subagent/end": "handoff", "compaction/start": "compaction", "compaction/end": "compaction", "error": "error", "evaluation": "evaluation",
}


def durable_stream(raw: DataFrame) -> DataFrame:
    """Durable session events with contiguous numbers: after the first gap of a session nothing is projected (the raw
    rows stay). Ignorable unknown kinds are markers, required ones give nothing."""
    from ..operators.sequences import after_discontinuity

    v = F.col("v")
    raw = raw.withColumns({"seq": F.try_variant_get(v, "$.event.seq", "long"), "kind": get(v, "event.type"), "captured_at": F.coalesce(instant(v, "event.time"), F.col("captured_at"))})
    whole = after_discontinuity(raw.where("seq IS NOT NULL"), ["session_id"], "seq", ["sequence"]).where("NOT quarantined")
    kind = F.coalesce(_case(F.col("kind"), DURABLE), F.when(F.try_variant_get(v, "$.event.ignorable", "boolean"), "model.inference"))
    actor = F.when(F.col("kind") == "message/user", "user").when(kind == "tool.result", "tool").otherwise("assistant")
    rows = _mapped(
        whole, event_type=kind, actor=actor, status=F.when((kind == "error") | F.coalesce(F.try_variant_get(v, "$.event.data.is_error", "boolean"), F.lit(False)), "error").otherwise("ok"), turn_id=F.coalesce(get(v, "event.data.turn_id", "event.data.turn"), F.col("turn_id")),
        step_id=get(v, "event.data.step_id", "event.data.step"), text=get(v, "event.data.text", "event.data.content", "event.data.result"), call_id=get(v, "event.data.call_id"), tool_name=get(v, "event.data.name"), **usage(v, "event.data.usage"),
    )
    return event_rows(rows, F.lit(0))


def chat_messages(messages: DataFrame, adapter: str = "import") -> DataFrame:
    """Canonical events of imported messages (conversation, message_id, parent_id, role, text, created, seq): ordered by
    seq if every message has one, else as they came; parents are linked by message id."""
    w = Window.partitionBy("conversation")
    rows = messages.withColumn("_in", F.monotonically_increasing_id()).withColumn("_all", F.bool_and(F.col("seq").isNotNull()).over(w))
    place = F.row_number().over(w.orderBy(F.when(F.col("_all"), F.col("seq")), "_in")) - 1
    span = lambda c: stable_id(F.lit(adapter), F.col("conversation"), F.col(c), length=16)
    known = messages.select("conversation", F.col("message_id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    rows = rows.withColumn("sequence", place.cast("long")).join(known, ["conversation", "parent_id"], "left")
    actor = _case(F.lower("role"), {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "system": "system", "tool": "tool"}, "environment")
    return rows.where(F.length("text") > 0).select(
        stable_id(F.col("conversation"), length=32).alias("trace_id"), F.concat_ws(":", F.lit(adapter), "message_id", F.lit("message")).alias("event_id"), span("message_id").alias("span_id"), F.when(F.col("_known"), span("parent_id")).alias("parent_span_id"),
        "sequence", F.lit("message").alias("event_type"), actor.alias("actor"), F.lit("ok").alias("status"), "text", "created",
    )


#: adapter -> interface -> normaliser. Rows of other pairs give no events.
ADAPTERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("messages", "stream-v1"): message_stream, ("items", "exec-v1"): item_stream, ("hooks", "hooks-v1"): hook_stream, ("durable", "session-v1"): durable_stream,
}


def normalize(raw: DataFrame, adapter: str, interface: str) -> DataFrame | None:
    made = ADAPTERS.get((adapter, interface))
    return made(raw.where((F.col("adapter") == adapter) & (F.col("interface_version") == interface))) if made else None
