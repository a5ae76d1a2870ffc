"""Canonical tables: DDL of events, raw envelopes and training examples; domains and row validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_TYPES = """message reasoning plan tool.call tool.result command.execution artifact.read artifact.write artifact.patch retrieval
model.inference evaluation feedback error compaction agent.invoke handoff approval.request approval.decision""".split()
STATUSES = ("ok", "error", "cancelled", "partial", "unknown")

RAW = """adapter string, interface_version string, captured_at timestamp, sequence long, source_event_id string, session_id string,
turn_id string, payload_sha256 string, payload string"""
EVENTS = """trace_id string, event_id string, span_id string, parent_span_id string, sequence long, started_at timestamp, ended_at timestamp,
event_type string, actor string, status string, source_event_id string, session_id string, turn_id string, step_id string,
content array<struct<ordinal: int, type: string, value: string>>, call_id string, tool_name string, exit_code int,
input_tokens double, output_tokens double, reasoning_tokens double, cache_read_tokens double, latency_ms double, cost_usd double, review_disposition string"""
EXAMPLES = """id string, trace_id string, source_event_ids array<string>,
messages array<struct<role: string, content: string, reasoning_content: string, tool_call_id: string, name: string, event_id: string, event_type: string,
  tool_calls: array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>>>,
tools array<struct<type: string, function: struct<name: string, description: string, parameters_json: string>>>, assistant_loss_mask array<boolean>,
training_targets array<struct<message_index: long, components: array<string>, loss_weight: double, source_event_ids: array<string>>>,
reward double, verifier struct<name: string, version: string>, metadata_json string, parquet_schema_version string"""


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def validate_events(events: DataFrame, order: str = "ordinal") -> DataFrame:
    """Adds ``violations``: ids, domains, end before start, repeated event ids, and sequences that don't rise in the
    stored order (column ``order``)."""
    w = Window.partitionBy("trace_id").orderBy(order)
    rows = events.withColumns({"_before": F.lag("sequence").over(w), "_same": F.count("*").over(Window.partitionBy("trace_id", "event_id"))})
    found = _codes(
        (~F.col("trace_id").rlike("^[a-f0-9]{32}$"), "TRACE_ID"), (~F.col("span_id").rlike("^[a-f0-9]{16}$"), "SPAN_ID"), (~F.col("event_type").isin(*EVENT_TYPES), "EVENT_TYPE"),
        (~F.col("status").isin(*STATUSES), "STATUS"), (F.col("ended_at") < F.col("started_at"), "END_BEFORE_START"), (F.col("sequence") < 0, "NEGATIVE_SEQUENCE"),
        (F.col("_same") > 1, "DUPLICATE_EVENT_ID"), (F.col("sequence") <= F.col("_before"), "SEQUENCE_ORDER"),
    )
    return rows.withColumn("violations", found).drop("_before", "_same")


def validate_examples(examples: DataFrame) -> DataFrame:
    """Adds ``violations``: mask length, targets out of range or on other roles, tool results without a call, and a
    reward without a verifier or the reverse."""
    n = F.size("messages")
    called = F.flatten(F.transform("messages", lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["id"]), F.array().cast("array<string>"))))
    found = _codes(
        (F.size("assistant_loss_mask") != n, "MASK_LENGTH"),
        (F.exists(F.coalesce("training_targets", F.array().cast("array<struct<message_index: long, components: array<string>, loss_weight: double, source_event_ids: array<string>>>")), lambda t: (t["message_index"] < 0) | (t["message_index"] >= n)), "TARGET_RANGE"),
        (F.exists(F.arrays_zip(F.col("messages.role").alias("r"), F.col("assistant_loss_mask").alias("l")), lambda z: z["l"] & (z["r"] != "assistant")), "LOSS_ROLE"),
        (F.exists("messages", lambda m: m["tool_call_id"].isNotNull() & ~F.array_contains(called, m["tool_call_id"])), "TOOL_RESULT_WITHOUT_CALL"),
        (F.col("reward").isNull() != F.col("verifier").isNull(), "REWARD_VERIFIER"),
    )
    return examples.withColumn("violations", found)
