"""Sinks: canonical JSON lines, trajectory documents, training examples, spans, and staged publication."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_id
from ..schema import EXAMPLES
from .jsonl import inventory

VERSION = "examples/0.1"


def step_units(events: DataFrame) -> DataFrame:
    """Trajectory steps: consecutive tool calls of one (session, turn, step) form a call group, results go to the
    latest group before them that has their call; every other event is a step."""
    from ..operators.sequences import islands

    whole = F.when(F.col("session_id").isNotNull() & F.col("turn_id").isNotNull() & F.col("step_id").isNotNull(), F.concat_ws("\x1f", "session_id", "turn_id", "step_id"))
    rows = islands(events, ["trace_id"], ["sequence", "event_id"], F.col("event_type") == "tool.call", whole)
    calls = rows.where("island IS NOT NULL")
    groups = calls.groupBy("trace_id", "island").agg(F.min("sequence").alias("start"), F.max("sequence").alias("end"))
    owners = calls.select("trace_id", "island", "call_id").join(groups.select("trace_id", "island", "end"), ["trace_id", "island"])
    results = rows.where("event_type = 'tool.result'").select("trace_id", "event_id", "sequence", "call_id")
    given = results.join(owners, ["trace_id", "call_id"]).where("end < sequence").groupBy("trace_id", "event_id").agg(F.max_by("island", "end").alias("owner"))
    rows = rows.join(given, ["trace_id", "event_id"], "left")
    group = F.coalesce(F.concat(F.lit("g"), F.coalesce("island", "owner").cast("string")), F.concat(F.lit("e"), F.col("event_id")))
    return rows.withColumn("unit", group).drop("island", "owner")


def trajectory_documents(events: DataFrame) -> DataFrame:
    """``trace_id, document``: steps with calls, observations and metrics, and final totals, as JSON; null fields are
    left out."""
    units = step_units(events)
    text = F.array_join(F.filter(F.transform("content", lambda c: c["value"]), lambda x: x.isNotNull()), "\n")
    kept = lambda cond, value: F.filter(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("sequence", value.alias("v"))))), lambda x: x["v"]), lambda x: x.isNotNull())
    call, result = F.col("event_type") == "tool.call", F.col("event_type") == "tool.result"
    steps = units.groupBy("trace_id", "unit").agg(
        F.min("sequence").alias("first"), F.min_by("actor", "sequence").alias("source"), F.array_join(kept(~call & ~result & (F.col("event_type") != "reasoning") & (text != ""), text), "\n").alias("message"),
        F.array_join(kept((F.col("event_type") == "reasoning") & (text != ""), text), "\n").alias("reasoning_content"), kept(call, F.struct(F.col("call_id").alias("tool_call_id"), F.col("tool_name").alias("function_name"), text.alias("arguments"))).alias("tool_calls"),
        kept(result, F.struct(F.col("call_id").alias("source_call_id"), text.alias("content"))).alias("observation"), F.sum("input_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"),
    )
    none = lambda c: F.when(F.size(c) > 0, F.col(c))
    step = F.struct("first", "source", F.nullif("message", F.lit("")).alias("message"), F.nullif("reasoning_content", F.lit("")).alias("reasoning_content"), none("tool_calls").alias("tool_calls"), none("observation").alias("observation"), "prompt_tokens", "completion_tokens", "cost_usd")
    docs = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    return docs.select("trace_id", F.to_json(F.struct("trace_id", "steps", F.struct(F.col("p").alias("total_prompt_tokens"), F.col("c").alias("total_completion_tokens"), F.size("steps").alias("total_steps")).alias("final_metrics"))).alias("document"))


def examples(events: DataFrame) -> DataFrame:
    """One chat example a session: messages in order with calls, tool results and reasoning, and the assistant mask."""
    text = F.array_join(F.filter(F.transform("content", lambda c: c["value"]), lambda x: x.isNotNull()), "\n")
    role = F.when(F.col("event_type") == "tool.result", "tool").when(F.col("actor").isin("assistant", "agent"), "assistant").when(F.col("actor") == "system", "system").otherwise("user")
    shown = events.where(F.col("event_type").isin("message", "reasoning", "tool.call", "tool.result", "plan") & (F.col("review_disposition") == "include") & (F.col("status") != "partial"))
    calls = F.when(F.col("event_type") == "tool.call", F.array(F.struct(F.col("call_id").alias("id"), F.lit("function").alias("type"), F.struct(F.col("tool_name").alias("name"), text.alias("arguments")).alias("function"))))
    plain = ~F.col("event_type").isin("reasoning", "tool.call")
    message = F.struct(
        role.alias("role"), F.when(plain, text).otherwise("").alias("content"), F.when(F.col("event_type") == "reasoning", text).alias("reasoning_content"), F.when(F.col("event_type") == "tool.result", F.col("call_id")).alias("tool_call_id"),
        F.when(F.col("event_type") == "tool.result", F.col("tool_name")).alias("name"), "event_id", "event_type", calls.alias("tool_calls"),
    )
    rows = shown.groupBy("trace_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "event_id", message.alias("m")))).alias("x"))
    rows = rows.withColumn("messages", F.transform("x", lambda x: x["m"]))
    used = F.array_sort(F.array_distinct(F.flatten(F.transform("messages", lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["function"]["name"]), F.array().cast("array<string>"))))))
    targets = F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", F.struct(i.cast("long").alias("message_index"), F.array(F.lit("content")).alias("components"), F.lit(1.0).alias("loss_weight"), F.array(m["event_id"]).alias("source_event_ids")))), lambda t: t.isNotNull())
    made = rows.select(
        stable_id(F.lit("example"), F.col("trace_id"), F.coalesce("session_id", F.lit(""))).alias("id"), "trace_id", F.transform("messages", lambda m: m["event_id"]).alias("source_event_ids"), "messages",
        F.transform(used, lambda n: F.struct(F.lit("function").alias("type"), F.struct(n.alias("name"), F.lit(None).cast("string").alias("description"), F.lit("{}").alias("parameters_json")).alias("function"))).alias("tools"),
        F.transform("messages", lambda m: m["role"] == "assistant").alias("assistant_loss_mask"), targets.alias("training_targets"), F.lit(None).cast("double").alias("reward"), F.lit(None).cast("struct<name: string, version: string>").alias("verifier"),
        F.lit("{}").alias("metadata_json"), F.lit(VERSION).alias("parquet_schema_version"),
    )
    return made


def spans(events: DataFrame) -> DataFrame:
    """``trace_id, spans``: one JSON array of spans a trace, times in nanoseconds as text."""
    nanos = lambda c: F.concat(F.unix_millis(c).cast("string"), F.lit("000000"))
    span = F.struct("sequence", F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("event_type").alias("name"), nanos("started_at").alias("startTimeUnixNano"), nanos(F.coalesce("ended_at", "started_at")).alias("endTimeUnixNano"), F.struct(F.when(F.col("status") == "error", 2).otherwise(1).alias("code")).alias("status")).alias("s"))
    return events.groupBy("trace_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"])).alias("spans"))


def compare_rows(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """``label`` of every difference: ``unexpected:<id>``, ``missing:<id>`` or ``row:<id>``; an empty array equals null."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        cols = [F.when(F.size(c) > 0, F.col(c)).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes if c != key]
        return df.select(key, F.sha2(F.to_json(F.struct(*cols)), 256).alias(name))

    both = digest(left, "l").join(digest(right, "r"), key, "full_outer")
    label = F.when(F.col("l").isNull(), "unexpected").when(F.col("r").isNull(), "missing").when(F.col("l") != F.col("r"), "row")
    return both.where(label.isNotNull()).select(F.concat_ws(":", label, F.col(key).cast("string")).alias("label"))


def publish(spark: SparkSession, path: str, tables: dict[str, Callable[[str], None]]) -> None:
    """Runs the writers into a staging folder beside ``path``, adds the checksums and a COMPLETE mark, and renames the
    folder; nothing is visible before it is whole."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}.staging"
    fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    for name, write in tables.items():
        write(f"{staging}/{name}")
    sums = inventory(spark, staging).select(F.regexp_extract("path", r"\.staging/(.*)$", 1).alias("path"), "bytes", "sha256")
    sums.write.json(f"{staging}/checksums")
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staging}/COMPLETE"))
    out.write(bytearray(json.dumps({"tables": sorted(tables)}).encode()))
    out.close()
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"{staging} can't be renamed")


def publish_canonical(spark: SparkSession, path: str, manifests: DataFrame, events: DataFrame, parts: DataFrame, reports: dict[str, DataFrame] | None = None) -> None:
    """Canonical folder: manifests and events as JSON lines, content values once a digest, and reports (small aggregates)
    as JSON. ``parts`` has sha256 and value; a value that isn't of its digest stops the publication."""
    wrong = parts.where(F.col("value").isNotNull() & (F.sha2("value", 256) != F.col("sha256"))).select("sha256").first()
    if wrong:
        raise ValueError(f"content {wrong[0]} isn't of its digest")
    # One row a digest is kept where the rows are first, so that a value that occurs everywhere is shuffled once a task.
    blobs = parts.where("value IS NOT NULL").groupBy("sha256").agg(F.first("value").alias("value"))
    tables = {"manifest": lambda p: manifests.write.json(p), "events": lambda p: events.write.json(p), "blobs": lambda p: blobs.write.parquet(p)}
    for name, report in (reports or {}).items():
        tables[f"reports/{name}"] = lambda p, r=report: r.coalesce(1).write.json(p)
    publish(spark, path, tables)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of every published file that is missing or changed."""
    listed = spark.read.schema("path string, bytes long, sha256 string").json(f"{path}/checksums")
    found = inventory(spark, path).select(F.element_at(F.split("path", f"/{path.rstrip('/').rpartition('/')[2]}/"), -1).alias("path"), F.col("sha256").alias("now"))
    return listed.join(found, "path", "left").where(~F.col("now").eqNullSafe(F.col("sha256"))).select("path")


def example_schema() -> str:
    return EXAMPLES


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda b: F.when(b, "1").otherwise("0")), "")
