"""Model rounds of canonical events, their usage, and the events that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_id

USAGE = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "latency_ms", "cost_usd")


def has_usage() -> Column:
    return F.coalesce(*[F.col(c).cast("double") for c in USAGE]).isNotNull()


def derive_rounds(events: DataFrame) -> DataFrame:
    """``trace_id, round, session_id, turn_id, evidence, sequence, first_event`` of every round of the selected events.

    Events that share trace, session, turn and step form a round if one of them is an inference or has usage; each
    inference or usage event without a step is a round of its own."""
    starts = (F.col("event_type") == "model.inference") | has_usage()
    key = stable_id(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("trace_id", "session_id", "turn_id", "step_id")])
    stepped = events.where("step_id IS NOT NULL").groupBy("trace_id", "session_id", "turn_id", "step_id", F.concat(F.lit("step:"), key).alias("round")).agg(
        F.bool_or(starts).alias("_starts"), F.min(F.struct("sequence", "event_id")).alias("_first")
    )
    stepped = stepped.where("_starts").select("trace_id", "round", "session_id", "turn_id", F.lit("source_step_id").alias("evidence"), "_first.sequence", F.col("_first.event_id").alias("first_event"))
    lone = events.where(F.col("step_id").isNull() & starts)
    own = F.concat(F.lit("inference:"), stable_id(F.col("trace_id"), F.col("event_id")))
    lone = lone.select("trace_id", own.alias("round"), "session_id", "turn_id", F.lit("inference_event").alias("evidence"), "sequence", F.col("event_id").alias("first_event"))
    return stepped.unionByName(lone)


def assign_events(events: DataFrame) -> DataFrame:
    """Adds ``round, how, round_sequence`` to every event of a trace that has rounds: ``member`` of its own round, or an
    orphan given to the latest round at or before it in its turn, else the turn's first round; without rounds in the
    turn, likewise among the trace's rounds. A round lies at its first event. One exchange on the trace serves all
    windows, which differ in their sorts only."""
    starts = (F.col("event_type") == "model.inference") | has_usage()
    key = F.concat(F.lit("step:"), stable_id(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("trace_id", "session_id", "turn_id", "step_id")]))
    lone = F.concat(F.lit("inference:"), stable_id(F.col("trace_id"), F.col("event_id")))
    rows = events.withColumns({"_name": F.when(F.col("step_id").isNotNull(), key).otherwise(lone), "_starts": starts}).repartition("trace_id")
    own = Window.partitionBy("trace_id", "_name")
    rows = rows.withColumns({"_member": F.bool_or("_starts").over(own), "_first": F.min(F.struct("sequence", "event_id")).over(own)})
    anchor = F.when(F.col("_member") & (F.struct("sequence", "event_id") == F.col("_first")), F.struct("sequence", "event_id", F.col("_name").alias("name")))
    rows = rows.withColumn("_anchor", anchor)
    for name, keys in (("_turn", ["trace_id", "session_id", "turn_id"]), ("_trace", ["trace_id"])):
        w = Window.partitionBy(*keys)
        rows = rows.withColumns({name: F.max("_anchor").over(w.orderBy("sequence").rangeBetween(Window.unboundedPreceding, 0)), f"{name}_first": F.min("_anchor").over(w)})
    found = F.coalesce("_turn", "_turn_first", "_trace", "_trace_first")
    member = F.col("_member")
    rows = rows.where(F.col("_trace_first").isNotNull()).withColumns({
        "round": F.when(member, F.col("_name")).otherwise(found["name"]), "round_sequence": F.when(member, F.col("_first.sequence")).otherwise(found["sequence"]),
        "how": F.when(member, "member").when(F.col("_turn_first").isNotNull(), "turn").otherwise("trace"),
    })
    return rows.drop("_name", "_starts", "_member", "_first", "_anchor", "_turn", "_turn_first", "_trace", "_trace_first")


def last_usage(assigned: DataFrame, *more: Column) -> DataFrame:
    """Per round of :func:`assign_events` the last non-null value of every usage field, each field on its own, and
    ``more`` aggregates."""
    order = F.struct("sequence", "event_id")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in USAGE]
    return assigned.groupBy("trace_id", "round", "round_sequence").agg(*last, *more)


def numbered(rounds: DataFrame) -> DataFrame:
    """Adds ``round_index``: the place of the round in its session."""
    w = Window.partitionBy("trace_id", "session_id").orderBy("sequence", "first_event")
    return rounds.withColumn("round_index", (F.row_number().over(w) - 1).cast("long"))
