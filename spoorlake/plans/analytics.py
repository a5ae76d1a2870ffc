"""Workload analytics over canonical events: scope, rounds, usage, tools, parallelism, errors, behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import basis_points
from ..operators import rounds as R
from ..operators import sequences as S
from .canonical import EV, canonical
from .registry import query

ACTIONS = ("tool.call", "command.execution", "artifact.patch", "artifact.write", "retrieval")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, sf_dir).where("include")


@query("scope_counts", EV + """ SELECT (SELECT count(DISTINCT trace_id) FROM ev) AS trace_count, (SELECT count(*) FROM ev) AS candidate_events,
  count(*) AS selected_events, (SELECT count(*) FROM ev WHERE NOT include) AS excluded_events,
  count(DISTINCT trace_id || '/' || coalesce(session_id, trace_id)) AS session_count,
  count(DISTINCT trace_id || '/' || coalesce(session_id, trace_id) || '/' || coalesce(turn_id, 'trace-fallback')) AS turn_count FROM sel""")  # fmt: skip
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, session = canonical(spark, sf_dir), F.coalesce("session_id", "trace_id")
    mine = lambda c: F.when(F.col("include"), c)
    return ev.agg(
        F.countDistinct("trace_id").alias("trace_count"), F.count("*").alias("candidate_events"), F.count_if("include").alias("selected_events"),
        F.count_if(~F.col("include")).alias("excluded_events"), F.countDistinct(mine(F.struct("trace_id", session))).alias("session_count"),
        F.countDistinct(mine(F.struct("trace_id", session, F.coalesce("turn_id", F.lit("trace-fallback"))))).alias("turn_count"),
    )


_FIRSTS = "firsts AS (SELECT trace_id, arg_min(provider, sequence) AS provider, arg_min(coalesce(model, 'unknown'), sequence) AS model FROM ev GROUP BY trace_id)"


@query("provider_model_histogram", EV + f", {_FIRSTS} SELECT 'provider' AS kind, provider AS name, count(*) AS n FROM firsts GROUP BY provider UNION ALL SELECT 'model', model, count(*) FROM firsts GROUP BY model")
def provider_model_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, order = canonical(spark, sf_dir), F.struct("sequence", "event_id")
    first = ev.groupBy("trace_id").agg(F.min_by(F.struct("provider", F.coalesce("model", F.lit("unknown")).alias("model")), order).alias("f")).select("f.*")
    return first.select(F.explode(F.array(F.struct(F.lit("provider").alias("kind"), F.col("provider").alias("name")), F.struct(F.lit("model").alias("kind"), F.col("model").alias("name")))).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


_STARTS = "(event_type = 'model.inference' OR coalesce(input_tokens, output_tokens, reasoning_tokens, cache_read_tokens, latency_ms) IS NOT NULL)"
_ROUNDS = f"""steps AS (SELECT trace_id, session_id, turn_id, step_id, min(sequence) AS sequence, bool_or({_STARTS}) AS starts FROM sel WHERE step_id IS NOT NULL GROUP BY ALL),
rounds AS (SELECT trace_id, session_id, turn_id, step_id, sequence, 'source_step_id' AS evidence FROM steps WHERE starts
  UNION ALL SELECT trace_id, session_id, turn_id, NULL, sequence, 'inference_event' FROM sel WHERE step_id IS NULL AND {_STARTS}),
members AS (SELECT s.trace_id, s.sequence AS seq, r.sequence AS round_seq FROM sel s JOIN rounds r ON s.trace_id = r.trace_id AND
  ((s.step_id IS NOT NULL AND r.step_id = s.step_id AND r.session_id IS NOT DISTINCT FROM s.session_id AND r.turn_id IS NOT DISTINCT FROM s.turn_id)
   OR (s.step_id IS NULL AND r.step_id IS NULL AND r.sequence = s.sequence))),
orphans AS (SELECT s.* FROM sel s LEFT JOIN members m ON m.trace_id = s.trace_id AND m.seq = s.sequence WHERE m.seq IS NULL),
given AS (SELECT o.trace_id, o.sequence AS seq,
  (SELECT max(r.sequence) FROM rounds r WHERE r.trace_id = o.trace_id AND r.session_id IS NOT DISTINCT FROM o.session_id AND r.turn_id IS NOT DISTINCT FROM o.turn_id AND r.sequence <= o.sequence) AS t1,
  (SELECT min(r.sequence) FROM rounds r WHERE r.trace_id = o.trace_id AND r.session_id IS NOT DISTINCT FROM o.session_id AND r.turn_id IS NOT DISTINCT FROM o.turn_id) AS t2,
  (SELECT max(r.sequence) FROM rounds r WHERE r.trace_id = o.trace_id AND r.sequence <= o.sequence) AS a1,
  (SELECT min(r.sequence) FROM rounds r WHERE r.trace_id = o.trace_id) AS a2 FROM orphans o),
assigned AS (SELECT trace_id, seq, round_seq, 'member' AS how FROM members
  UNION ALL SELECT trace_id, seq, coalesce(t1, t2, a1, a2), CASE WHEN t2 IS NOT NULL THEN 'turn' ELSE 'trace' END FROM given WHERE a2 IS NOT NULL)"""


@query("round_derivation", EV + ", " + _ROUNDS + " SELECT trace_id, sequence, evidence, row_number() OVER (PARTITION BY trace_id, session_id ORDER BY sequence) - 1 AS round_index FROM rounds")
def round_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered(R.derive_rounds(selected(spark, sf_dir))).select("trace_id", "sequence", "evidence", "round_index")


@query("orphan_to_round_asof", EV + ", " + _ROUNDS + " SELECT trace_id, seq AS sequence, round_seq AS round_sequence, how FROM assigned WHERE how <> 'member'")
def orphan_to_round_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assign_events(selected(spark, sf_dir)).where("how <> 'member'").select("trace_id", "sequence", "round_sequence", "how")


_LAST = ", ".join(f"arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS {c}" for c in ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "latency_ms"))
_USAGE = EV + ", " + _ROUNDS + f", u AS (SELECT a.trace_id, a.round_seq, {_LAST} FROM assigned a JOIN (SELECT *, sequence AS seq2 FROM sel) s ON s.trace_id = a.trace_id AND s.seq2 = a.seq GROUP BY 1, 2)"


@query("round_usage_last_non_null", _USAGE + " SELECT trace_id, round_seq AS round_sequence, input_tokens, output_tokens, reasoning_tokens, cache_read_tokens, latency_ms FROM u")
def round_usage_last_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_usage(R.assign_events(selected(spark, sf_dir))).select("trace_id", "round_sequence", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "latency_ms")


@query("usage_summary", _USAGE + """ SELECT count(*) AS rounds, count(input_tokens) AS input_rounds, coalesce(sum(input_tokens), 0)::BIGINT AS input_total, count(output_tokens) AS output_rounds, coalesce(sum(output_tokens), 0)::BIGINT AS output_total,
  CASE WHEN sum(input_tokens) > 0 THEN floor(coalesce(sum(cache_read_tokens), 0) * 10000.0 / sum(input_tokens) + 0.5)::BIGINT END AS cache_read_to_input_bp,
  CASE WHEN sum(output_tokens) > 0 THEN floor(coalesce(sum(reasoning_tokens), 0) * 10000.0 / sum(output_tokens) + 0.5)::BIGINT END AS reasoning_to_output_bp FROM u""")  # fmt: skip
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = round_usage_last_non_null(spark, sf_dir)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return u.agg(
        F.count("*").alias("rounds"), F.count("input_tokens").alias("input_rounds"), total("input_tokens").alias("input_total"), F.count("output_tokens").alias("output_rounds"), total("output_tokens").alias("output_total"),
        basis_points(total("cache_read_tokens"), total("input_tokens")).alias("cache_read_to_input_bp"), basis_points(total("reasoning_tokens"), total("output_tokens")).alias("reasoning_to_output_bp"),
    )


# The oracle pairs call by call (recursion over the calls of a key), not by the closed form.
_PAIRS = """c AS (SELECT trace_id, call_id, sequence, row_number() OVER (PARTITION BY trace_id, call_id ORDER BY sequence) AS i FROM sel WHERE event_type = 'tool.call' AND call_id IS NOT NULL),
r AS (SELECT trace_id, call_id, sequence FROM sel WHERE event_type = 'tool.result' AND call_id IS NOT NULL),
p AS (SELECT c.trace_id, c.call_id, c.i, c.sequence AS call_sequence, (SELECT min(r.sequence) FROM r WHERE r.trace_id = c.trace_id AND r.call_id = c.call_id AND r.sequence > c.sequence) AS result_sequence FROM c WHERE i = 1
  UNION ALL SELECT c.trace_id, c.call_id, c.i, c.sequence, (SELECT min(r.sequence) FROM r WHERE r.trace_id = c.trace_id AND r.call_id = c.call_id AND r.sequence > c.sequence AND r.sequence > coalesce(p.result_sequence, 1000000000))
  FROM p JOIN c ON c.trace_id = p.trace_id AND c.call_id = p.call_id AND c.i = p.i + 1)"""
_PAIRS = EV.replace("WITH raw", "WITH RECURSIVE raw", 1) + ", " + _PAIRS


def pairs(ev: DataFrame) -> DataFrame:
    """Calls (also without an id) with their result."""
    calls = ev.where("event_type = 'tool.call'").select("trace_id", "call_id", "sequence", F.col("event_id").alias("call_event"))
    results = ev.where("event_type = 'tool.result' AND call_id IS NOT NULL").select("trace_id", "call_id", "sequence", F.col("event_id").alias("result_event"))
    keyed = S.greedy_pairs(calls.where("call_id IS NOT NULL"), results, ["trace_id", "call_id"], "sequence", "call_event", "result_event")
    lone = calls.where("call_id IS NULL").select("trace_id", "call_id", "call_event", F.lit(None).cast("string").alias("result_event"))
    return keyed.select("trace_id", "call_id", "call_event", "result_event").unionByName(lone)


@query("tool_pairs_greedy", _PAIRS + " SELECT trace_id, call_id, call_sequence, result_sequence FROM p")
def tool_pairs_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir)
    place = ev.select("trace_id", "event_id", "sequence")
    out = pairs(ev).where("call_id IS NOT NULL").join(place.toDF("trace_id", "call_event", "call_sequence"), ["trace_id", "call_event"])
    return out.join(place.toDF("trace_id", "result_event", "result_sequence"), ["trace_id", "result_event"], "left").select("trace_id", "call_id", "call_sequence", "result_sequence")


def timed_pairs(ev: DataFrame) -> DataFrame:
    cols = ["status", "started_at", "ended_at"]
    call = ev.select("trace_id", F.col("event_id").alias("call_event"), *[F.col(c).alias(f"call_{c}") for c in cols])
    result = ev.select("trace_id", F.col("event_id").alias("result_event"), *[F.col(c).alias(f"result_{c}") for c in cols])
    out = pairs(ev).join(call, ["trace_id", "call_event"]).join(result, ["trace_id", "result_event"], "left")
    ms = F.unix_millis(F.coalesce("result_ended_at", "result_started_at")) - F.unix_millis("call_started_at")
    return out.withColumn("latency_ms", F.when(ms >= 0, ms))


_TIMED = _PAIRS + """, t AS (SELECT p.*, c.status AS call_status, r.status AS result_status, coalesce(r.ended_ms, r.started_ms) - c.started_ms AS ms FROM p
  JOIN sel c ON c.trace_id = p.trace_id AND c.sequence = p.call_sequence LEFT JOIN sel r ON r.trace_id = p.trace_id AND r.sequence = p.result_sequence)"""  # fmt: skip


@query("tool_metrics", _TIMED + """ SELECT (SELECT count(*) FROM sel WHERE event_type = 'tool.call') AS call_count, (SELECT count(*) FROM sel WHERE event_type = 'tool.result') AS result_count,
  count(result_sequence) AS paired_call_count, (SELECT count(*) FROM sel WHERE event_type = 'tool.call') - count(result_sequence) AS unpaired_call_count,
  (SELECT count(*) FROM sel WHERE event_type = 'tool.result') - count(result_sequence) AS orphan_result_count,
  count(*) FILTER (call_status = 'error' OR result_status IN ('error', 'cancelled')) + (SELECT count(*) FROM sel WHERE event_type = 'tool.call' AND call_id IS NULL AND status = 'error') AS failed_call_count FROM t""")  # fmt: skip
def tool_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir)
    failed = (F.col("call_status") == "error") | F.coalesce(F.col("result_status").isin("error", "cancelled"), F.lit(False))
    found = timed_pairs(ev).agg(F.count("*").alias("call_count"), F.count("result_event").alias("paired_call_count"), F.count_if(failed).alias("failed_call_count"))
    results = ev.where("event_type = 'tool.result'").agg(F.count("*").alias("result_count"))
    out = found.join(F.broadcast(results))  # one row each
    return out.select("call_count", "result_count", "paired_call_count", (F.col("call_count") - F.col("paired_call_count")).alias("unpaired_call_count"), (F.col("result_count") - F.col("paired_call_count")).alias("orphan_result_count"), "failed_call_count")


@query("tool_latency_quantiles", _TIMED + """ SELECT count(ms) AS samples, min(ms) AS min_ms, max(ms) AS max_ms, floor(avg(ms) + 0.5)::BIGINT AS mean_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms FROM t WHERE ms >= 0""")
def tool_latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timed_pairs(selected(spark, sf_dir)).where("latency_ms IS NOT NULL")
    return t.selectExpr(
        "count(latency_ms) AS samples", "min(latency_ms) AS min_ms", "max(latency_ms) AS max_ms", "CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS mean_ms",
        "percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50_ms", "percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms",
    )


@query("tool_pairs_first", EV + """, c AS (SELECT trace_id, call_id, min(sequence) AS call_sequence FROM sel WHERE event_type = 'tool.call' AND call_id IS NOT NULL GROUP BY 1, 2)
  SELECT c.trace_id, c.call_id, c.call_sequence, min(r.sequence) AS result_sequence FROM c LEFT JOIN sel r ON r.event_type = 'tool.result' AND r.trace_id = c.trace_id AND r.call_id = c.call_id AND r.sequence > c.call_sequence GROUP BY 1, 2, 3""")  # fmt: skip
def tool_pairs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir).where("call_id IS NOT NULL")
    calls = ev.where("event_type = 'tool.call'").groupBy("trace_id", "call_id").agg(F.min("sequence").alias("call_sequence"))
    results = ev.where("event_type = 'tool.result'").select("trace_id", "call_id", F.col("sequence").alias("call_sequence"), F.col("sequence").alias("sequence"))
    out = S.first_after(calls, results, ["trace_id", "call_id"], "call_sequence", ["sequence"], "result_")
    return out.select("trace_id", "call_id", "call_sequence", "result_sequence")


@query("tool_results_unique", EV + """ SELECT c.trace_id, c.sequence AS call_sequence, min(r.sequence) AS result_sequence FROM sel c JOIN sel r ON r.trace_id = c.trace_id AND r.call_id = c.call_id AND r.sequence > c.sequence AND r.event_type = 'tool.result'
  AND (r.session_id = c.session_id OR r.session_id IS NULL OR c.session_id IS NULL) AND (r.turn_id = c.turn_id OR r.turn_id IS NULL OR c.turn_id IS NULL)
  WHERE c.event_type = 'tool.call' GROUP BY 1, 2 HAVING count(*) = 1""")  # fmt: skip
def tool_results_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with exactly one later result of their id whose session and turn don't differ (null fits all)."""
    ev = selected(spark, sf_dir).where("call_id IS NOT NULL")
    out = S.unique_after(ev.where("event_type = 'tool.call'"), ev.where("event_type = 'tool.result'"), ["trace_id", "call_id"], "sequence", ["session_id", "turn_id"], "event_id")
    return out.select("trace_id", F.col("sequence").alias("call_sequence"), F.col("found").alias("result_sequence"))


@query("dangling_calls_orphan_results", EV + """, c AS (SELECT DISTINCT trace_id, call_id FROM sel WHERE event_type = 'tool.call' AND call_id IS NOT NULL), r AS (SELECT DISTINCT trace_id, call_id FROM sel WHERE event_type = 'tool.result' AND call_id IS NOT NULL)
  SELECT 'dangling' AS kind, c.trace_id, c.call_id FROM c ANTI JOIN r USING (trace_id, call_id) UNION ALL SELECT 'orphan', r.trace_id, r.call_id FROM r ANTI JOIN c USING (trace_id, call_id)""")  # fmt: skip
def dangling_calls_orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir).where("call_id IS NOT NULL")
    kinds = ev.groupBy("trace_id", "call_id").agg(F.bool_or(F.col("event_type") == "tool.call").alias("c"), F.bool_or(F.col("event_type") == "tool.result").alias("r"))
    return kinds.where("c <> r").select(F.when(F.col("c"), "dangling").otherwise("orphan").alias("kind"), "trace_id", "call_id")


_PARALLEL = EV + """, t AS (SELECT trace_id, call_id, sequence, event_type, sum(CASE event_type WHEN 'tool.call' THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id, call_id ORDER BY sequence) AS s FROM sel WHERE call_id IS NOT NULL),
  o AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY trace_id, call_id ORDER BY sequence)) AS open FROM t),
  d AS (SELECT *, open - coalesce(lag(open) OVER (PARTITION BY trace_id, call_id ORDER BY sequence), 0) AS step FROM o),
  a AS (SELECT *, sum(step) OVER (PARTITION BY trace_id ORDER BY sequence) AS total FROM d),
  b AS (SELECT *, total - step AS running, coalesce(sum(CASE WHEN event_type = 'tool.result' AND total = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS busy FROM a)"""  # fmt: skip


@query("parallel_metrics", _PARALLEL + """ SELECT trace_id, count(DISTINCT busy) FILTER (event_type = 'tool.call' AND running > 0) AS parallel_groups, count(*) FILTER (event_type = 'tool.call' AND running > 0) AS additional_calls,
  coalesce(max(CASE WHEN event_type = 'tool.call' THEN running + 1 END), 0)::BIGINT AS max_concurrency FROM b GROUP BY trace_id""")  # fmt: skip
def parallel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_call, is_result = F.col("event_type") == "tool.call", F.col("event_type") == "tool.result"
    rows = S.parallel_activity(selected(spark, sf_dir), ["trace_id"], "call_id", ["sequence", "event_id"], is_call, is_result)
    return rows.groupBy("trace_id").agg(
        F.countDistinct(F.when(F.col("is_parallel"), F.col("busy"))).alias("parallel_groups"), F.count_if("is_parallel").alias("additional_calls"),
        F.coalesce(F.max(F.when(is_call, F.col("running") + 1)), F.lit(0)).cast("long").alias("max_concurrency"),
    )


@query("parallel_first_calls", EV + """, t AS (SELECT *, row_number() OVER (PARTITION BY trace_id, call_id, event_type ORDER BY sequence) AS n FROM sel WHERE call_id IS NOT NULL),
  m AS (SELECT trace_id, call_id, min(sequence) FILTER (event_type = 'tool.call') AS c FROM t GROUP BY 1, 2),
  e AS (SELECT m.trace_id, m.call_id, m.c, (SELECT min(r.sequence) FROM t r WHERE r.event_type = 'tool.result' AND r.trace_id = m.trace_id AND r.call_id = m.call_id AND r.sequence > m.c) AS r FROM m WHERE m.c IS NOT NULL)
  SELECT x.trace_id, x.call_id, x.c AS sequence, (SELECT count(*) FROM e y WHERE y.trace_id = x.trace_id AND y.c < x.c AND (y.r IS NULL OR y.r > x.c)) AS running FROM e x""")  # fmt: skip
def parallel_first_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set semantics: only the first call of an id opens it, the first later result closes it."""
    ev = selected(spark, sf_dir).where("call_id IS NOT NULL")
    calls = ev.where("event_type = 'tool.call'").groupBy("trace_id", "call_id").agg(F.min("sequence").alias("sequence"))
    results = ev.where("event_type = 'tool.result'").select("trace_id", "call_id", "sequence")
    spans = S.first_after(calls, results, ["trace_id", "call_id"], "sequence", ["sequence"], "end_")
    points = spans.select("trace_id", "call_id", F.explode(F.array(F.struct(F.col("sequence").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_sequence").alias("at"), F.lit(-1).alias("d")))).alias("p")).where("p.at IS NOT NULL")
    w = Window.partitionBy("trace_id").orderBy("p.at").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("running", F.coalesce(F.sum("p.d").over(w), F.lit(0)).cast("long")).where("p.d = 1").select("trace_id", "call_id", F.col("p.at").alias("sequence"), "running")


@query("tool_call_islands", EV + """, t AS (SELECT *, event_type = 'tool.call' AS m, CASE WHEN session_id IS NOT NULL AND step_id IS NOT NULL THEN session_id || '/' || turn_id END AS b FROM sel),
  n AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER w AND lag(b) OVER w = b, false) THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY trace_id ORDER BY sequence)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY sequence) AS island FROM n)
  SELECT trace_id, island::BIGINT AS island, count(*) AS calls, min(sequence) AS first_sequence FROM g WHERE m GROUP BY 1, 2""")  # fmt: skip
def tool_call_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    boundary = F.when(F.col("session_id").isNotNull() & F.col("step_id").isNotNull(), F.concat_ws("/", "session_id", "turn_id"))
    rows = S.islands(selected(spark, sf_dir), ["trace_id"], ["sequence", "event_id"], F.col("event_type") == "tool.call", boundary)
    return rows.where("island IS NOT NULL").groupBy("trace_id", "island").agg(F.count("*").alias("calls"), F.min("sequence").alias("first_sequence"))


@query("counter_unmatched_boundaries", EV + """, t AS (SELECT trace_id, turn_id, sum(CASE event_type WHEN 'tool.call' THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id, turn_id ORDER BY sequence) AS s, sequence FROM sel WHERE event_type IN ('tool.call', 'tool.result'))
  SELECT trace_id, turn_id, (-least(0, min(s)) + arg_max(s, sequence) - least(0, min(s)))::BIGINT AS unmatched FROM t GROUP BY 1, 2""")  # fmt: skip
def counter_unmatched_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts that no end closes plus ends without a start, per turn (calls as starts, results as ends)."""
    up, down = F.col("event_type") == "tool.call", F.col("event_type") == "tool.result"
    rows = S.open_counters(selected(spark, sf_dir).where(up | down), up, down, ["trace_id", "turn_id"], ["sequence"])
    lost = F.sum(F.when(up, 1).otherwise(-1))
    # Leftover starts = the last open count; ends lost at zero = leftover - (starts - ends).
    left = F.max_by("open", "sequence")
    return rows.groupBy("trace_id", "turn_id").agg((left + left - lost).cast("long").alias("unmatched"))


@query("sequence_gaps", EV + """, d AS (SELECT trace_id, sequence, count(*) AS n FROM sel GROUP BY 1, 2), g AS (SELECT *, greatest(0, sequence - lag(sequence) OVER (PARTITION BY trace_id ORDER BY sequence) - 1) AS gap FROM d)
  SELECT trace_id, coalesce(sum(gap), 0)::BIGINT AS gap_count, sum(n - 1)::BIGINT AS duplicate_count FROM g GROUP BY 1""")  # fmt: skip
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequence_gaps(selected(spark, sf_dir), ["trace_id"], "sequence")


@query("contiguity_quarantine", EV + """, b AS (SELECT *, CASE WHEN sequence = coalesce(lag(sequence) OVER (PARTITION BY trace_id ORDER BY sequence) + 1, 0) THEN 0 ELSE 1 END AS broken FROM sel),
  q AS (SELECT *, max(broken) OVER (PARTITION BY trace_id ORDER BY sequence) AS q FROM b) SELECT trace_id, count(*) FILTER (q = 0) AS kept, count(*) FILTER (q = 1) AS quarantined FROM q GROUP BY 1""")  # fmt: skip
def contiguity_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.after_discontinuity(selected(spark, sf_dir), ["trace_id"], "sequence", ["sequence"])
    return rows.groupBy("trace_id").agg(F.count_if(~F.col("quarantined")).alias("kept"), F.count_if("quarantined").alias("quarantined"))


@query("first_error_recovery", _PAIRS + """, f AS (SELECT trace_id, min(sequence) AS sequence FROM sel WHERE status = 'error' OR event_type = 'error' GROUP BY 1),
  ok AS (SELECT s.trace_id, s.sequence, coalesce(s.ended_ms, s.started_ms) AS ms FROM sel s LEFT JOIN p ON p.trace_id = s.trace_id AND p.result_sequence = s.sequence WHERE s.status = 'ok' AND (s.event_type = 'evaluation' OR p.result_sequence IS NOT NULL)),
  rec AS (SELECT f.trace_id, f.sequence, min(ok.sequence) AS recovery_sequence FROM f LEFT JOIN ok ON ok.trace_id = f.trace_id AND ok.sequence > f.sequence GROUP BY 1, 2)
  SELECT rec.trace_id, rec.sequence, e.event_type, rec.recovery_sequence, CASE WHEN ok.ms >= e.started_ms THEN ok.ms - e.started_ms END AS recovery_latency_ms FROM rec JOIN sel e ON e.trace_id = rec.trace_id AND e.sequence = rec.sequence
  LEFT JOIN ok ON ok.trace_id = rec.trace_id AND ok.sequence = rec.recovery_sequence""")  # fmt: skip
def first_error_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir)
    failed = (F.col("status") == "error") | (F.col("event_type") == "error")
    first = ev.where(failed).groupBy("trace_id").agg(F.min(F.struct("sequence", "event_id", "event_type", "started_at")).alias("f")).select("trace_id", "f.sequence", "f.event_type", F.unix_millis("f.started_at").alias("failed_ms"))
    used = pairs(ev).where("result_event IS NOT NULL").select("trace_id", F.col("result_event").alias("event_id"), F.lit(True).alias("paired"))
    fine = ev.where("status = 'ok'").join(used, ["trace_id", "event_id"], "left").where((F.col("event_type") == "evaluation") | F.col("paired"))
    fine = fine.select("trace_id", "sequence", F.unix_millis(F.coalesce("ended_at", "started_at")).alias("ms"))
    out = S.first_after(first, fine, ["trace_id"], "sequence", ["sequence", "ms"], "recovery_")
    latency = F.when(F.col("recovery_ms") >= F.col("failed_ms"), F.col("recovery_ms") - F.col("failed_ms"))
    return out.select("trace_id", "sequence", "event_type", "recovery_sequence", latency.alias("recovery_latency_ms"))


@query("behavior_counts", EV + """ SELECT trace_id, count(*) FILTER (event_type = 'evaluation') AS evaluations, count(*) FILTER (event_type = 'tool.call') AS actions, count(*) FILTER (status IN ('error', 'cancelled')) AS failed,
  count(*) FILTER (status = 'partial') AS partial, CASE WHEN count(*) FILTER (event_type = 'tool.call') > 0 THEN floor(count(*) FILTER (event_type = 'evaluation') * 10000.0 / count(*) FILTER (event_type = 'tool.call') + 0.5)::BIGINT END AS evaluation_to_action_bp,
  count(*) FILTER (status = 'ok') AS allowed, count(*) FILTER (status IN ('error', 'cancelled')) AS denied, count(*) FILTER (status = 'partial') AS undecided FROM sel GROUP BY 1""")  # fmt: skip
def behavior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda c, *v: F.count_if(F.col(c).isin(*v))
    outcome = F.when(F.col("status").isin("cancelled", "error"), "deny").when(F.col("status") == "ok", "allow").otherwise("unknown")
    ev = selected(spark, sf_dir).withColumn("outcome", outcome)
    return ev.groupBy("trace_id").agg(
        is_("event_type", "evaluation").alias("evaluations"), is_("event_type", *ACTIONS).alias("actions"), is_("status", "error", "cancelled").alias("failed"), is_("status", "partial").alias("partial"),
        basis_points(is_("event_type", "evaluation"), is_("event_type", *ACTIONS)).alias("evaluation_to_action_bp"),
        is_("outcome", "allow").alias("allowed"), is_("outcome", "deny").alias("denied"), is_("outcome", "unknown").alias("undecided"),
    )


@query("training_yield", EV + """ SELECT count(*) AS candidates, count(*) FILTER (include) AS selected, floor(count(*) FILTER (include) * 10000.0 / count(*) + 0.5)::BIGINT AS selected_event_yield_bp,
  count(*) FILTER (NOT include) AS review_excluded, count(*) FILTER (include AND status = 'partial') AS not_scanned, count(*) FILTER (include AND status = 'cancelled') AS quarantined, count(*) FILTER (include AND event_type = 'model.inference' AND status = 'ok') AS loss_candidates FROM ev""")  # fmt: skip
def training_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, kept = canonical(spark, sf_dir), F.col("include")
    return ev.agg(
        F.count("*").alias("candidates"), F.count_if(kept).alias("selected"), basis_points(F.count_if(kept), F.count("*")).alias("selected_event_yield_bp"), F.count_if(~kept).alias("review_excluded"),
        F.count_if(kept & (F.col("status") == "partial")).alias("not_scanned"), F.count_if(kept & (F.col("status") == "cancelled")).alias("quarantined"),
        F.count_if(kept & (F.col("event_type") == "model.inference") & (F.col("status") == "ok")).alias("loss_candidates"),
    )


@query("egs_completeness", EV + """, a AS (SELECT trace_id, turn_id, min(sequence) AS a FROM sel WHERE event_type = 'tool.call' GROUP BY 1, 2),
  o AS (SELECT a.*, EXISTS (SELECT 1 FROM sel s WHERE s.trace_id = a.trace_id AND s.turn_id = a.turn_id AND s.event_type = 'model.inference' AND s.sequence < a.a) AS observed,
    (SELECT min(sequence) FROM sel s WHERE s.trace_id = a.trace_id AND s.turn_id = a.turn_id AND s.event_type = 'tool.result' AND s.sequence > a.a) AS r FROM a),
  v AS (SELECT o.*, EXISTS (SELECT 1 FROM sel s WHERE s.trace_id = o.trace_id AND s.turn_id = o.turn_id AND s.event_type = 'evaluation' AND s.sequence >= o.r) AS verified FROM o)
  SELECT trace_id, count(*) AS action_turns, sum(1 + observed::INT + (r IS NOT NULL)::INT + verified::INT)::BIGINT AS phases, count(*) FILTER (observed AND r IS NOT NULL) AS grounded_turns, count(*) FILTER (observed AND r IS NOT NULL AND verified) AS complete_turns,
  sum(1 + observed::INT + (r IS NOT NULL)::INT + verified::INT) / (4.0 * count(*)) AS egs FROM v GROUP BY 1""")  # fmt: skip
def egs_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation before, action, result after, verification from the result on: phases of each turn with an action."""
    seq = lambda kind: F.when(F.col("event_type") == kind, F.col("sequence"))
    ev, turn = selected(spark, sf_dir), ["trace_id", "turn_id"]
    w = Window.partitionBy(*turn)
    ev = ev.withColumn("a", F.min(seq("tool.call")).over(w)).where("a IS NOT NULL")
    ev = ev.withColumn("r", F.min(F.when(F.col("sequence") > F.col("a"), seq("tool.result"))).over(w))
    turns = ev.groupBy(*turn).agg(
        F.coalesce(F.bool_or((F.col("event_type") == "model.inference") & (F.col("sequence") < F.col("a"))), F.lit(False)).cast("int").alias("o"), F.max(F.col("r").isNotNull()).cast("int").alias("r"),
        F.coalesce(F.bool_or((F.col("event_type") == "evaluation") & (F.col("sequence") >= F.col("r"))), F.lit(False)).cast("int").alias("v"),
    )
    phases = 1 + F.col("o") + F.col("r") + F.col("v")
    return turns.groupBy("trace_id").agg(
        F.count("*").alias("action_turns"), F.sum(phases).alias("phases"), F.count_if((F.col("o") == 1) & (F.col("r") == 1)).alias("grounded_turns"),
        F.count_if(phases == 4).alias("complete_turns"), (F.sum(phases) / (4 * F.count("*"))).alias("egs"),
    )


@query("split_contamination", EV + """ SELECT (SELECT count(*) FROM (SELECT trace_id, turn_id FROM sel GROUP BY 1, 2 HAVING count(DISTINCT split) > 1)) AS keys_in_several_splits,
  CASE WHEN max(started_ms) FILTER (split = 'train') > min(started_ms) FILTER (split = 'test') THEN 1 ELSE 0 END::BIGINT AS chronology_signal FROM sel""")  # fmt: skip
def split_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir)
    keys = ev.groupBy("trace_id", "turn_id").agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("keys_in_several_splits"))
    at = lambda s: F.when(F.col("split") == s, F.col("started_at"))
    late = F.coalesce((F.max(at("train")) > F.min(at("test"))).cast("long"), F.lit(0).cast("long"))
    return keys.join(F.broadcast(ev.agg(late.alias("chronology_signal"))))  # one row each


@query("handoff_pairs", EV + """ SELECT i.trace_id, i.sequence AS invoke_sequence, min(h.sequence) AS handoff_sequence FROM sel i LEFT JOIN sel h ON h.event_type = 'evaluation' AND h.trace_id = i.trace_id AND h.k % 10 = i.k % 10 AND h.sequence > i.sequence WHERE i.event_type = 'model.inference' GROUP BY 1, 2""")
def handoff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hand-off (here: evaluations) after each invocation (inferences) with its correlation id (k % 10)."""
    ev = selected(spark, sf_dir).withColumn("id", F.col("k") % 10)
    out = S.first_after(ev.where("event_type = 'model.inference'").select("trace_id", "id", "sequence"), ev.where("event_type = 'evaluation'").select("trace_id", "id", "sequence"), ["trace_id", "id"], "sequence", ["sequence"], "handoff_")
    return out.select("trace_id", F.col("sequence").alias("invoke_sequence"), "handoff_sequence")


@query("failure_recovery_chain", EV + """, f AS (SELECT trace_id, sequence FROM sel WHERE event_type = 'error'),
  a AS (SELECT f.trace_id, f.sequence, min(s.sequence) AS retry FROM f JOIN sel s ON s.trace_id = f.trace_id AND s.sequence > f.sequence AND s.event_type = 'model.inference' GROUP BY 1, 2),
  b AS (SELECT a.trace_id, a.sequence, a.retry, min(s.sequence) AS act FROM a JOIN sel s ON s.trace_id = a.trace_id AND s.sequence > a.retry AND s.event_type = 'tool.call' GROUP BY 1, 2, 3),
  c AS (SELECT b.trace_id, b.sequence, b.retry, b.act, min(s.sequence) AS outcome FROM b JOIN sel s ON s.trace_id = b.trace_id AND s.sequence > b.act AND s.event_type = 'tool.result' GROUP BY 1, 2, 3, 4)
  SELECT c.trace_id, c.sequence AS failure_sequence, retry AS retry_sequence, act AS action_sequence, outcome AS outcome_sequence FROM c JOIN sel s ON s.trace_id = c.trace_id AND s.sequence = c.outcome WHERE s.status = 'ok'""")  # fmt: skip
def failure_recovery_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure, first later retry marker, first later action, first later outcome, which must be successful."""
    ev = selected(spark, sf_dir)
    of = lambda kind: ev.where(F.col("event_type") == kind).select("trace_id", "sequence", "status")
    out = of("error").select("trace_id", F.col("sequence").alias("failure_sequence"))
    for kind, after, name in (("model.inference", "failure_sequence", "retry_"), ("tool.call", "retry_sequence", "action_"), ("tool.result", "action_sequence", "outcome_")):
        right = of(kind).withColumn(after, F.col("sequence"))
        out = S.first_after(out, right, ["trace_id"], after, ["sequence", "status"], name).where(F.col(f"{name}sequence").isNotNull()).drop("retry_status", "action_status")
    return out.where("outcome_status = 'ok'").drop("outcome_status")


@query("workload_rows", _USAGE + """ SELECT u.trace_id, u.round_seq AS round_sequence, count(*) AS events, count(*) FILTER (s.event_type = 'tool.call') AS tools, count(*) FILTER (s.status = 'error') AS errors, any_value(u.input_tokens) AS input_tokens,
  CASE WHEN any_value(u.input_tokens) IS NOT NULL THEN greatest(any_value(u.input_tokens) - coalesce(any_value(u.cache_read_tokens), 0), 0) END AS newly_appended FROM u JOIN assigned a ON a.trace_id = u.trace_id AND a.round_seq = u.round_seq JOIN sel s ON s.trace_id = a.trace_id AND s.sequence = a.seq GROUP BY 1, 2""")  # fmt: skip
def workload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count("*").alias("events"), F.count_if(F.col("event_type") == "tool.call").alias("tools"), F.count_if(F.col("status") == "error").alias("errors")]
    out = R.last_usage(R.assign_events(selected(spark, sf_dir)), *counts)
    fresh = F.greatest(F.col("input_tokens") - F.coalesce("cache_read_tokens", F.lit(0)), F.when(F.col("input_tokens").isNotNull(), 0).cast("long"))
    return out.select("trace_id", "round_sequence", "events", "tools", "errors", "input_tokens", F.when(F.col("input_tokens").isNotNull(), fresh).alias("newly_appended"))
