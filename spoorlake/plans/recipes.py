"""Training-view recipes over canonical events: candidates become views or exclusions with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from .analytics import pairs, selected
from .canonical import EV, canonical
from .registry import query


@query("reasoning_sft_groups", EV + """ SELECT trace_id, coalesce(step_id, event_id) AS step, count(*) AS deltas, min(sequence) AS first_sequence, CASE WHEN bool_and(status = 'ok') THEN 'view' ELSE 'REASONING_INCOMPLETE' END AS outcome
  FROM sel WHERE event_type = 'model.inference' GROUP BY 1, 2""")  # fmt: skip
def reasoning_sft_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning (here: inferences) grouped by step; a group is a view only if every part is complete."""
    ev = selected(spark, sf_dir).where("event_type = 'model.inference'")
    outcome = F.when(F.bool_and(F.col("status") == "ok"), "view").otherwise("REASONING_INCOMPLETE")
    return ev.groupBy("trace_id", F.coalesce("step_id", "event_id").alias("step")).agg(F.count("*").alias("deltas"), F.min("sequence").alias("first_sequence"), outcome.alias("outcome"))


@query("tool_use_sft_groups")
def tool_use_sft_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of consecutive calls whose every call has a result; else the reason."""
    ev = selected(spark, sf_dir)
    boundary = F.when(F.col("session_id").isNotNull() & F.col("step_id").isNotNull(), F.concat_ws("/", "session_id", "turn_id"))
    calls = S.islands(ev, ["trace_id"], ["sequence", "event_id"], F.col("event_type") == "tool.call", boundary).where("island IS NOT NULL")
    found = pairs(ev).select("trace_id", F.col("call_event").alias("event_id"), "result_event")
    whole = F.bool_and(F.col("result_event").isNotNull())
    return calls.join(found, ["trace_id", "event_id"], "left").groupBy("trace_id", "island").agg(F.count("*").alias("calls"), F.min("sequence").alias("first_sequence"), F.when(whole, "view").otherwise("TOOL_RESULT_MISSING").alias("outcome"))


@query("reward_labels", EV + """ SELECT l.trace_id, l.sequence AS label_sequence, t.sequence AS target_sequence, CASE WHEN t.sequence IS NULL THEN 'TARGET_MISSING' WHEN t.status <> 'ok' THEN 'TARGET_NOT_OK' ELSE 'view' END AS outcome
  FROM sel l LEFT JOIN sel t ON t.trace_id = l.trace_id AND t.sequence = l.sequence - 1 - l.k % 3 AND t.event_type IN ('model.inference', 'tool.call') WHERE l.event_type = 'evaluation'""")  # fmt: skip
def reward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (evaluations) and the event that they name, which must precede them, be the model's, and be ok."""
    ev = selected(spark, sf_dir)
    labels = ev.where("event_type = 'evaluation'").select("trace_id", F.col("sequence").alias("label_sequence"), (F.col("sequence") - 1 - F.col("k") % 3).alias("target_sequence"))
    targets = ev.where("event_type IN ('model.inference', 'tool.call')").select("trace_id", F.col("sequence").alias("target_sequence"), "status")
    out = labels.join(targets.withColumn("there", F.lit(True)), ["trace_id", "target_sequence"], "left")
    outcome = F.when(F.col("there").isNull(), "TARGET_MISSING").when(F.col("status") != "ok", "TARGET_NOT_OK").otherwise("view")
    return out.select("trace_id", "label_sequence", F.when(F.col("there"), F.col("target_sequence")).alias("target_sequence"), outcome.alias("outcome"))


@query("teacher_route_asof", EV + """, h AS (SELECT trace_id, session_id, sequence, provider, model FROM sel WHERE event_type = 'model.inference' AND step_id IS NULL)
  SELECT t.trace_id, t.sequence, (SELECT max(h.sequence) FROM h WHERE h.trace_id = t.trace_id AND h.session_id IS NOT DISTINCT FROM t.session_id AND h.sequence <= t.sequence) AS header_sequence FROM sel t WHERE t.event_type = 'tool.call'""")  # fmt: skip
def teacher_route_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's latest request header (stepless inferences) in its session at or before it."""
    ev = selected(spark, sf_dir)
    headers = ev.where("event_type = 'model.inference' AND step_id IS NULL").select("trace_id", "session_id", "sequence", F.col("sequence").alias("header_sequence"))
    calls = ev.where("event_type = 'tool.call'").select("trace_id", "session_id", "sequence")
    return S.asof_backward(calls, headers, ["trace_id", "session_id"], "sequence", ["header_sequence"]).select("trace_id", "sequence", "header_sequence")


@query("trace_summary", EV + """ SELECT trace_id, count(*) AS events, count(*) FILTER (include) AS included, count(*) FILTER (NOT include) AS excluded, count(*) FILTER (status = 'error') AS blockers, max(coalesce(ended_ms, started_ms)) - min(started_ms) AS duration_ms FROM ev GROUP BY 1""")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.max(F.unix_millis(F.coalesce("ended_at", "started_at"))) - F.min(F.unix_millis("started_at"))
    return canonical(spark, sf_dir).groupBy("trace_id").agg(F.count("*").alias("events"), F.count_if("include").alias("included"), F.count_if(~F.col("include")).alias("excluded"), F.count_if(F.col("status") == "error").alias("blockers"), span.alias("duration_ms"))


@query("review_edits", EV + """, e AS (SELECT trace_id, sequence, k % 2 = 0 AS include2 FROM ev WHERE k % 9 = 4) SELECT ev.trace_id, count(*) FILTER (coalesce(e.include2, ev.include)) AS included, count(e.sequence) AS edits FROM ev LEFT JOIN e ON e.trace_id = ev.trace_id AND e.sequence = ev.sequence GROUP BY 1""")
def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of edits merged into the events: an edit replaces the review disposition."""
    ev = canonical(spark, sf_dir)
    edits = ev.where("k % 9 = 4").select("trace_id", "event_id", (F.col("k") % 2 == 0).alias("edited"))
    both = ev.join(edits, ["trace_id", "event_id"], "left")
    return both.groupBy("trace_id").agg(F.count_if(F.coalesce("edited", "include")).alias("included"), F.count("edited").alias("edits"))


@query("excluded_tool_projection", EV + """, x AS (SELECT DISTINCT trace_id, call_id FROM ev WHERE NOT include AND call_id IS NOT NULL AND event_type IN ('tool.call', 'tool.result'))
  SELECT count(*) AS kept FROM sel LEFT JOIN x ON x.trace_id = sel.trace_id AND x.call_id = sel.call_id WHERE x.call_id IS NULL""")  # fmt: skip
def excluded_tool_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool events of whose call any part is excluded are dropped whole."""
    ev = canonical(spark, sf_dir)
    hidden = ev.where("NOT include AND call_id IS NOT NULL").select("trace_id", "call_id").distinct()
    return ev.where("include").join(hidden, ["trace_id", "call_id"], "left_anti").agg(F.count("*").alias("kept"))


@query("append_order", EV + """ SELECT trace_id, event_id, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, event_id) - 1 AS place FROM sel""")
def append_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("trace_id").orderBy("started_at", "event_id")
    return selected(spark, sf_dir).select("trace_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("paired_contingency", EV + """, u AS (SELECT trace_id, bool_or(event_type = 'tool.result' AND status = 'ok') AS a, bool_or(event_type = 'evaluation' AND status = 'ok' AND k % 4 = 0) AS b FROM sel GROUP BY 1)
  SELECT a, b, count(*) AS n FROM u GROUP BY 1, 2""")  # fmt: skip
def paired_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("status") == "ok"
    u = selected(spark, sf_dir).groupBy("trace_id").agg(F.bool_or((F.col("event_type") == "tool.result") & ok).alias("a"), F.bool_or((F.col("event_type") == "evaluation") & ok & (F.col("k") % 4 == 0)).alias("b"))
    return u.groupBy("a", "b").agg(F.count("*").alias("n"))
