"""Canonical events made from the driver's ``events`` table, and the same as a SQL prefix for oracles.

One trace a user; views are tool calls, clicks their results, sign-ups inferences, purchases evaluations, errors errors.
The JSON property ``k`` supplies steps, call ids, statuses, review decisions and split labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table

_TYPES = {"error": "error", "view": "tool.call", "click": "tool.result", "purchase": "evaluation", "signup": "model.inference"}


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair]), F.col("event_type"))
    k, inference = F.col("k"), F.col("event_type") == "signup"
    cents = F.round(F.col("value") * 100).cast("long")
    return raw.select(
        F.md5(F.col("user_id").cast("string")).alias("trace_id"),
        F.col("event_id").cast("string").alias("event_id"),
        (F.row_number().over(order) - 1).cast("long").alias("sequence"),
        F.col("ts").alias("started_at"),
        F.when(k % 2 == 0, F.timestamp_millis(F.unix_millis("ts") + cents)).alias("ended_at"),
        kind.alias("event_type"),
        F.when((F.col("event_type") == "error") | (k % 17 == 0), "error").when(k % 19 == 0, "cancelled").when(k % 23 == 0, "partial").otherwise("ok").alias("status"),
        F.when(k % 13 != 0, F.lit("s0")).alias("session_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("turn_id"),
        F.when(k % 3 != 0, k.cast("string")).alias("step_id"),
        F.when(F.col("event_type").isin("view", "click") & (k % 7 != 0), (k % 5).cast("string")).alias("call_id"),
        F.when(inference, cents).alias("input_tokens"),
        F.when(inference & (k % 2 == 0), F.floor(cents / 3).cast("long")).alias("output_tokens"),
        F.when(inference & (k % 4 == 0), F.floor(cents / 7).cast("long")).alias("reasoning_tokens"),
        F.when(inference & (k % 5 != 0), F.floor(cents / 2).cast("long")).alias("cache_read_tokens"),
        F.when(F.col("event_type") == "purchase", F.when(k % 6 == 0, cents.cast("double"))).alias("latency_ms"),
        F.lit(None).cast("double").alias("cost_usd"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))).alias("model"),
        (k % 10 != 9).alias("include"),
        F.when(k % 4 == 0, "train").when(k % 4 == 1, "test").alias("split"),
        k.alias("k"),
    )


EV = """WITH raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
ev AS (SELECT md5(CAST(user_id AS VARCHAR)) AS trace_id, CAST(event_id AS VARCHAR) AS event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, ts AS started_at,
  CASE WHEN k % 2 = 0 THEN epoch_us(ts) // 1000 + cents END AS ended_ms, epoch_us(ts) // 1000 AS started_ms,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'tool.call' WHEN 'click' THEN 'tool.result' WHEN 'purchase' THEN 'evaluation' ELSE 'model.inference' END AS event_type,
  CASE WHEN event_type = 'error' OR k % 17 = 0 THEN 'error' WHEN k % 19 = 0 THEN 'cancelled' WHEN k % 23 = 0 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN k % 13 <> 0 THEN 's0' END AS session_id, strftime(ts, '%Y-%m-%d') AS turn_id,
  CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) END AS step_id,
  CASE WHEN event_type IN ('view', 'click') AND k % 7 <> 0 THEN CAST(k % 5 AS VARCHAR) END AS call_id,
  CASE WHEN event_type = 'signup' THEN cents END AS input_tokens,
  CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN cents // 3 END AS output_tokens,
  CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN cents // 7 END AS reasoning_tokens,
  CASE WHEN event_type = 'signup' AND k % 5 <> 0 THEN cents // 2 END AS cache_read_tokens,
  CASE WHEN event_type = 'purchase' AND k % 6 = 0 THEN CAST(cents AS DOUBLE) END AS latency_ms,
  'p' || (user_id % 4) AS provider, CASE WHEN user_id % 5 <> 0 THEN 'm' || (user_id % 3) END AS model,
  k % 10 <> 9 AS include, CASE WHEN k % 4 = 0 THEN 'train' WHEN k % 4 = 1 THEN 'test' END AS split, k FROM raw),
sel AS (SELECT * FROM ev WHERE include)"""
