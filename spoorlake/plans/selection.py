"""Selection, privacy, topology and dataset queries over canonical events with synthetic content parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import DOMAIN, stable_id
from ..functions.text import bound
from ..operators import selection as S
from .canonical import EV, canonical
from .registry import query, table

#: Fields of part o of an event with property k, for both engines.
_PART = {
    "ordinal": "o", "type": "CASE (k + o) % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'tool_call' WHEN 3 THEN 'tool_result' WHEN 4 THEN 'text' ELSE 'code' END",
    "value": "CASE WHEN (k + o) % 11 = 0 THEN NULL WHEN (k + o) % 13 = 0 THEN '' ELSE concat('v', CAST((k + o) % 40 AS STRING)) END", "blob_ref": "CASE WHEN (k + o) % 11 = 0 AND k % 2 = 0 THEN 'blob' END",
    "sha256": "md5(CAST((k + o) % 40 AS STRING))", "status": "CASE (k + o) % 7 WHEN 0 THEN 'redacted' WHEN 1 THEN 'not_scanned' WHEN 2 THEN 'quarantined' ELSE 'passed' END",
    "sensitivity": "CASE k % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END", "keep": "(k + 2 * o) % 9 <> 0", "representation": "CASE WHEN (k + o) % 5 = 0 THEN 'provider_summary' ELSE 'provider_exposed_reasoning' END",
    "claim": "CASE WHEN (k + o) % 8 = 0 THEN 'none' ELSE 'chain_of_thought' END", "visibility": "CASE WHEN k % 19 = 0 THEN 'not_returned' ELSE 'returned' END", "source_field": "CASE WHEN k % 23 = 0 THEN '' ELSE 'reasoning_content' END",
}
_SPANS = {
    "actor": "CASE WHEN event_type = 'tool.result' THEN 'environment' ELSE 'assistant' END", "span_id": "concat('s', CAST(sequence AS STRING))", "parent_span_id": "CASE WHEN k % 4 = 0 THEN concat('s', CAST(sequence - 1 - k % 2 AS STRING)) END", "link": "CASE WHEN k % 5 = 0 THEN concat('s', CAST(sequence + 2 AS STRING)) END",
}
_P = EV + ", s AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _SPANS.items()) + " FROM ev), p AS (SELECT s.trace_id, s.event_id, s.sequence, s.event_type, s.turn_id, s.step_id, s.include, s.k, " + ", ".join(f"{e} AS {'part_type' if n == 'type' else n}" for n, e in _PART.items()) + " FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS o FROM s) s)"


def events(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = tuple(_PART)) -> DataFrame:
    """``fields``: those of the parts that the caller reads; others needn't be made."""
    ev = canonical(spark, sf_dir)
    ev = ev.select("*", *[F.expr(e).alias(n) for n, e in _SPANS.items()])
    parts = "transform(sequence(0L, k % 3), o -> named_struct(" + ", ".join(f"'{n}', {_PART[n]}" for n in fields) + "))"
    return ev.withColumns({"content": F.expr(parts), "links": F.array_compact(F.array("link"))})


@query("event_texts", _P + """, q AS (SELECT trace_id, event_id, coalesce(string_agg(value, chr(10) ORDER BY ordinal) FILTER (part_type NOT IN ('reasoning', 'tool_call', 'tool_result') AND value <> ''), '') AS text,
    coalesce(count(*) FILTER (part_type = 'reasoning') > 0 AND bool_and(representation = 'provider_exposed_reasoning' AND claim = 'chain_of_thought' AND visibility <> 'not_returned' AND source_field <> '' AND value IS NOT NULL) FILTER (part_type = 'reasoning'), false) AS strict_reasoning,
    concat_ws(',', CASE WHEN bool_or(value IS NULL AND blob_ref IS NOT NULL) THEN 'BLOB_CONTENT_UNAVAILABLE' END, CASE WHEN bool_or(status NOT IN ('passed', 'redacted')) THEN 'CONTENT_NOT_PRIVACY_CLEARED' END) AS issues FROM p WHERE keep GROUP BY 1, 2)
  SELECT s.trace_id, s.event_id, coalesce(text, '') AS text, coalesce(strict_reasoning, false) AS strict_reasoning, coalesce(issues, '') AS issues FROM s LEFT JOIN q ON q.trace_id = s.trace_id AND q.event_id = s.event_id""")  # fmt: skip
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return events(spark, sf_dir).select("trace_id", "event_id", S.ordinary_text(c).alias("text"), S.strict_reasoning(c).alias("strict_reasoning"), F.array_join(S.privacy_issues(c), ",").alias("issues"))


@query("reasoning_texts", _P + """, f AS (SELECT trace_id, turn_id, sha256, min(sequence * 10 + ordinal) AS first, any_value(value) AS value FROM p WHERE keep AND part_type = 'reasoning' AND value IS NOT NULL AND value <> '' GROUP BY 1, 2, 3)
  SELECT trace_id, turn_id, string_agg(value, chr(10) ORDER BY first) AS text, count(*) AS parts FROM f GROUP BY 1, 2""")  # fmt: skip
def reasoning_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here empty values are left out first: the synthetic digest doesn't tell them from others."""
    ev = events(spark, sf_dir).withColumn("content", F.filter("content", lambda p: p["value"] != ""))
    return S.reasoning_texts(ev, ["trace_id", "turn_id"], ["sequence"])


_EXCLUDED = "SELECT trace_id, event_id FROM p WHERE NOT keep AND ((event_type = 'tool.call' AND part_type = 'tool_call') OR (event_type = 'tool.result' AND part_type = 'tool_result'))"
_IDENTITY = """'{"actor":"' || actor || '","event_type":"' || event_type || '","scope":"redacted-%s","sequence":' || sequence || ',"trace_id":"' || trace_id || '"}'"""


@query("export_view", _P + f""", x AS ({_EXCLUDED}), c AS (SELECT s.* FROM s ANTI JOIN x ON x.trace_id = s.trace_id AND x.event_id = s.event_id WHERE s.include), r AS (SELECT DISTINCT trace_id, event_id FROM p WHERE keep AND status = 'redacted'),
  h AS (SELECT c.trace_id, c.span_id, substr(sha256({_IDENTITY % "span"}), 1, 16) AS new_span FROM c SEMI JOIN r ON r.trace_id = c.trace_id AND r.event_id = c.event_id), n AS (SELECT trace_id, event_id, count(*) AS parts FROM p WHERE keep GROUP BY 1, 2)
  SELECT c.trace_id, c.sequence, CASE WHEN h.new_span IS NULL THEN c.event_id ELSE 'redacted:' || substr(sha256({_IDENTITY.replace("actor ", "c.actor ").replace("event_type ||", "c.event_type ||").replace("sequence ||", "c.sequence ||").replace("trace_id ||", "c.trace_id ||") % "event"}), 1, 32) END AS event_id, h.new_span IS NOT NULL AS rekeyed,
    coalesce(h.new_span, c.span_id) AS span_id, coalesce(hp.new_span, c.parent_span_id) AS parent_span_id, coalesce(hl.new_span, c.link, '') AS links, coalesce(n.parts, 0) AS parts
  FROM c LEFT JOIN h ON h.trace_id = c.trace_id AND h.span_id = c.span_id LEFT JOIN h hp ON hp.trace_id = c.trace_id AND hp.span_id = c.parent_span_id LEFT JOIN h hl ON hl.trace_id = c.trace_id AND hl.span_id = c.link LEFT JOIN n ON n.trace_id = c.trace_id AND n.event_id = c.event_id""")  # fmt: skip
def export_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.export_view(events(spark, sf_dir, ("ordinal", "type", "status", "keep")), "redacted")
    return out.select("trace_id", "sequence", "event_id", "rekeyed", "span_id", "parent_span_id", F.array_join("links", ",").alias("links"), "parts")


@query("redaction_report", _P + f""", x AS ({_EXCLUDED}), c AS (SELECT p.* FROM p ANTI JOIN x ON x.trace_id = p.trace_id AND x.event_id = p.event_id WHERE p.include AND p.keep)
  SELECT 'redaction_status' AS field, status AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'sensitivity', sensitivity, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'parts', 'original', count(*) FROM p UNION ALL SELECT 'parts', 'exported', count(*) FROM c""")  # fmt: skip
def redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by redaction status and sensitivity of what is exported, and of parts before and after: one pass."""
    ev = events(spark, sf_dir, ("type", "status", "sensitivity", "keep"))
    # Parts are counted by what decides their rows, and made once; only those few counts become rows.
    of = lambda c: F.transform(c, lambda p: F.struct((F.col("include") & ~S.projection_excluded(F.col("event_type"), c) & p["keep"]).alias("out"), p["status"].alias("status"), p["sensitivity"].alias("sensitivity")))
    parts = ev.select(F.explode(bound(F.col("content"), of)).alias("p")).groupBy("p.out", "p.status", "p.sensitivity").agg(F.count("*").alias("n"))
    out = F.col("out")
    row = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    each = F.array(row("parts", F.lit("original")), F.when(out, row("parts", F.lit("exported"))), F.when(out, row("redaction_status", F.col("status"))), F.when(out, row("sensitivity", F.col("sensitivity"))))
    return parts.select("n", F.explode(F.array_compact(each)).alias("r")).groupBy("r.field", "r.value").agg(F.sum("n").alias("n"))


@query("span_topology", _P.split(", p AS (")[0] + """ , m AS (SELECT trace_id, parent_span_id AS span_id, 1 AS parent FROM s WHERE parent_span_id IS NOT NULL UNION ALL SELECT trace_id, link, 0 FROM s WHERE link IS NOT NULL)
  SELECT m.trace_id, count(*) FILTER (parent = 1) AS missing_parents, count(*) FILTER (parent = 0) AS missing_links FROM m LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM s) t ON t.trace_id = m.trace_id AND t.span_id = m.span_id WHERE t.span_id IS NULL GROUP BY 1""")  # fmt: skip
def span_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.topology(events(spark, sf_dir))


@query("structural_links", _P.split(", p AS (")[0] + """ SELECT a.trace_id, a.sequence, coalesce(a.parent_span_id = b.span_id, false) OR coalesce(b.parent_span_id = a.span_id, false) OR coalesce(a.link = b.span_id, false) OR coalesce(b.link = a.span_id, false) AS linked
  FROM s a JOIN s b ON b.trace_id = a.trace_id AND b.sequence = a.sequence + 2 WHERE a.event_type = 'tool.call'""")  # fmt: skip
def structural_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a call and the event two places later are linked by their spans."""
    w = Window.partitionBy("trace_id").orderBy("sequence")
    side = F.struct("span_id", "parent_span_id", "links")
    both = events(spark, sf_dir).withColumns({"a": side, "b": F.lead(side, 2).over(w)}).where("event_type = 'tool.call' AND b IS NOT NULL")
    return both.select("trace_id", "sequence", S.linked("a", "b").alias("linked"))


@query("timeline_filters", EV + """, c AS (SELECT unnest(['messages', 'tools', 'artifacts', 'issues']) AS filter) SELECT trace_id, filter, count(*) AS events, count(*) FILTER (contains(lower(event_id), '7') OR contains(event_type, '7')) AS matching FROM ev, c
  WHERE CASE filter WHEN 'messages' THEN event_type IN ('message', 'reasoning', 'plan', 'model.inference') WHEN 'tools' THEN event_type LIKE 'tool.%' WHEN 'artifacts' THEN event_type LIKE 'artifact.%' ELSE status <> 'ok' END GROUP BY 1, 2""")  # fmt: skip
def timeline_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewer's filters of events, and a query text within them."""
    ev, kind = canonical(spark, sf_dir), F.col("event_type")
    of = {"messages": kind.isin("message", "reasoning", "plan", "model.inference"), "tools": F.startswith(kind, F.lit("tool.")), "artifacts": F.startswith(kind, F.lit("artifact.")), "issues": F.col("status") != "ok"}
    each = ev.select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in of.items()]))).alias("filter"))
    asked = F.contains(F.lower("event_id"), F.lit("7")) | F.contains(kind, F.lit("7"))
    return each.groupBy("trace_id", "filter").agg(F.count("*").alias("events"), F.count_if(asked).alias("matching"))


@query("approval_outcomes", EV + """, d AS (SELECT *, CASE k % 8 WHEN 0 THEN 'Approved' WHEN 1 THEN 'deny' WHEN 2 THEN 'ABORT' WHEN 3 THEN 'later' WHEN 4 THEN 'accept' END AS word FROM sel)
  SELECT CASE WHEN lower(word) IN ('approved', 'accept') THEN 'allow' WHEN lower(word) IN ('deny', 'abort') OR status IN ('cancelled', 'error') THEN 'deny' WHEN status = 'ok' THEN 'allow' ELSE 'unknown' END AS outcome, count(*) AS events,
    count(*) FILTER (event_type = 'model.inference' AND (k % 9 = 0 OR k % 10 = 0)) AS subagents FROM d GROUP BY 1""")  # fmt: skip
def approval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, k = canonical(spark, sf_dir).where("include"), F.col("k") % 8
    word = F.when(k == 0, "Approved").when(k == 1, "deny").when(k == 2, "ABORT").when(k == 3, "later").when(k == 4, "accept")
    started = S.subagent_start(F.when(F.col("event_type") == "model.inference", "agent.invoke").otherwise(F.col("event_type")), F.when(F.col("k") % 9 == 0, "SubagentStart"), F.when(F.col("k") % 10 == 0, "a"))
    return ev.withColumn("sub", started).groupBy(S.approval_outcome(word, F.col("status")).alias("outcome")).agg(F.count("*").alias("events"), F.count_if("sub").alias("subagents"))


_COMMANDS = ["npm run test", "cd x && pytest -q", "cargo build", "go test ./...", "echo pytests", "yarn test:unit", "run;vitest", "mvnw test"]


@query("event_predicates", EV + f""", c AS (SELECT *, {_COMMANDS!r}[k % 8 + 1] AS command, ['Start', 'completed', 'x', 'PreCompact', NULL][k % 5 + 1] AS phase, ['a/retry', 'retrying', NULL, 'retry_2'][k % 4 + 1] AS life FROM ev)
  SELECT trace_id, count(*) FILTER (k % 8 IN (0, 1, 3, 5, 6, 7)) AS test_runs, count(*) FILTER (lower(phase) IN ('start', 'precompact')) AS starts, count(*) FILTER (lower(phase) = 'completed') AS ends,
    count(*) FILTER (k % 7 = 0 OR k % 6 > 1 AND k % 3 = 0 OR k % 11 = 0 OR life IN ('a/retry', 'retry_2')) AS retries FROM c GROUP BY 1""")  # fmt: skip
def event_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test runs, compaction phases and retries by their evidence."""
    at = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("k") % n + 1).cast("int"))
    k, phase = F.col("k"), S.compaction_phase(at(["Start", "completed", "x", "PreCompact", None], 5))
    retry = S.is_retry(k % 7 == 0, F.when(k % 3 == 0, k % 6), F.when(k % 11 == 0, "again"), at(["a/retry", "retrying", None, "retry_2"], 4))
    return canonical(spark, sf_dir).groupBy("trace_id").agg(F.count_if(S.runs_tests(at(_COMMANDS, 8))).alias("test_runs"), F.count_if(phase == "start").alias("starts"), F.count_if(phase == "end").alias("ends"), F.count_if(retry).alias("retries"))


@query("call_names", EV + """, f AS (SELECT trace_id, call_id, min(sequence) AS first FROM sel WHERE call_id IS NOT NULL GROUP BY 1, 2) SELECT trace_id, call_id, 'call_' || (row_number() OVER (PARTITION BY trace_id ORDER BY first) - 1) AS name FROM f""")
def call_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.call_names(canonical(spark, sf_dir).where("include"), "trace_id", ["sequence"], "call_id")


@query("tool_definitions", EV + """ SELECT trace_id, 'tool' || (k % 6) AS name, min(sequence) AS first_sequence, arg_min(k, sequence) AS first_schema, arg_max(k, sequence) AS last_schema FROM sel WHERE event_type = 'tool.call' GROUP BY 1, 2""")
def tool_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tool the schema of its first call (agent format), and of its last (examples)."""
    calls = canonical(spark, sf_dir).where("include AND event_type = 'tool.call'").withColumn("name", F.concat(F.lit("tool"), (F.col("k") % 6).cast("string")))
    return calls.groupBy("trace_id", "name").agg(F.min("sequence").alias("first_sequence"), F.min_by("k", "sequence").alias("first_schema"), F.max_by("k", "sequence").alias("last_schema"))


@query("verified_labels", EV + """, l AS (SELECT l.*, t.event_id AS target FROM sel l JOIN ev t ON t.trace_id = l.trace_id AND t.sequence = l.sequence - 1 - l.k % 3 WHERE l.event_type = 'evaluation' AND l.latency_ms IS NOT NULL AND l.k % 4 <> 0)
  SELECT trace_id, max(sequence) AS sequence, arg_max(latency_ms, sequence) AS reward, arg_max(target, sequence) AS target FROM l GROUP BY 1""")  # fmt: skip
def verified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace's last valid label: with a reward, a confirmation (here: k not divisible by 4) and a target that exists."""
    ev = canonical(spark, sf_dir)
    labels = ev.where("include AND event_type = 'evaluation' AND latency_ms IS NOT NULL AND k % 4 <> 0").select("trace_id", "sequence", "latency_ms", (F.col("sequence") - 1 - F.col("k") % 3).alias("at"))
    found = labels.join(ev.select("trace_id", F.col("sequence").alias("at"), F.col("event_id").alias("target")), ["trace_id", "at"])
    return found.groupBy("trace_id").agg(F.max("sequence").alias("sequence"), F.max_by("latency_ms", "sequence").alias("reward"), F.max_by("target", "sequence").alias("target"))


COMMON_TOOLS = ("bash", "read", "write", "edit", "search")


@query("timing_events", EV + f""", n AS (SELECT *, [' Bash', 'read', 'my_tool', NULL, 'WRITE ', 'other'][k % 6 + 1] AS name FROM sel WHERE call_id IS NOT NULL)
  SELECT trace_id, event_id, 'tool_' || substr(sha256(concat_ws(chr(31), '{DOMAIN}.ref/v1', 'tool', trace_id, call_id)), 1, 24) AS call_ref,
    CASE WHEN event_type = 'tool.call' THEN CASE WHEN name IS NULL THEN 'unknown' WHEN lower(trim(name)) IN {COMMON_TOOLS!r} THEN lower(trim(name)) ELSE 'custom_' || substr(sha256(concat_ws(chr(31), '{DOMAIN}.tool/v1', name)), 1, 12) END END AS tool_name, CASE WHEN event_type = 'tool.result' THEN status IN ('error', 'cancelled') END AS is_error FROM n""")  # fmt: skip
def timing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events for publication: references are digests, and tools go by a common name or a digest of their own."""
    name = F.element_at(F.array(*[F.lit(v).cast("string") for v in (" Bash", "read", "my_tool", None, "WRITE ", "other")]), (F.col("k") % 6 + 1).cast("int"))
    plain = F.lower(F.trim(name))
    safe = F.when(name.isNull(), "unknown").when(plain.isin(*COMMON_TOOLS), plain).otherwise(F.concat(F.lit("custom_"), stable_id(F.lit(f"{DOMAIN}.tool/v1"), name, length=12)))
    ev = canonical(spark, sf_dir).where("include AND call_id IS NOT NULL")
    ref = F.concat(F.lit("tool_"), stable_id(F.lit(f"{DOMAIN}.ref/v1"), F.lit("tool"), F.col("trace_id"), F.col("call_id"), length=24))
    return ev.select("trace_id", "event_id", ref.alias("call_ref"), F.when(F.col("event_type") == "tool.call", safe).alias("tool_name"), F.when(F.col("event_type") == "tool.result", F.col("status").isin("error", "cancelled")).alias("is_error"))


@query("settled_events", EV + """ SELECT trace_id, step_id, count(*) FILTER (status = 'partial') AS partial, count(*) AS events FROM (SELECT *, bool_or(status <> 'partial') OVER (PARTITION BY trace_id, step_id) AS whole FROM ev WHERE step_id IS NOT NULL) WHERE status <> 'partial' OR NOT whole GROUP BY 1, 2""")
def settled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.settled(canonical(spark, sf_dir).where("step_id IS NOT NULL"), ["trace_id", "step_id"])
    return out.groupBy("trace_id", "step_id").agg(F.count_if(F.col("status") == "partial").alias("partial"), F.count("*").alias("events"))


@query("store_listing", """WITH v AS (SELECT o_custkey AS trace_id, o_orderkey AS generation, md5(CAST(o_orderkey AS VARCHAR)) AS digest FROM orders), t AS (SELECT trace_id, max(generation) AS deleted FROM v WHERE generation % 7 = 0 GROUP BY 1), l AS (SELECT trace_id, max(generation) AS generation, arg_max(digest, generation) AS digest FROM v GROUP BY 1)
  SELECT l.* FROM l LEFT JOIN t ON t.trace_id = l.trace_id WHERE deleted IS NULL OR deleted < generation""")  # fmt: skip
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trace_id"), F.col("o_orderkey").alias("generation"), F.md5(F.col("o_orderkey").cast("string")).alias("digest"))
    return S.store_listing(v, v.where("generation % 7 = 0").select("trace_id", "generation"))


@query("group_map_cover", """WITH w AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), g AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 16 = 1 GROUP BY 1)
  SELECT coalesce(w.id, g.id) AS id, CASE WHEN g.id IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM w FULL JOIN g ON g.id = w.id WHERE g.id IS NULL OR w.id IS NULL OR n > 1""")  # fmt: skip
def group_map_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of groups must name exactly the selected traces, each once."""
    wanted = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"))
    return S.cover(wanted, table(spark, sf_dir, "orders").where("o_orderkey % 16 = 1").select(F.col("o_custkey").alias("id")), "id")


@query("shard_order", """SELECT o_custkey AS archive, count(*) AS shards, min(i) = 0 AND count(DISTINCT i) = count(*) AND max(i) = count(*) - 1 AS whole FROM (SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 5 ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 END AS i FROM orders) GROUP BY 1""")
def shard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderkey") % 5).otherwise(place).alias("i"))
    return S.contiguous(rows, "archive", "i")


@query("limited_parts", _P + """, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY sequence, ordinal) AS place FROM p) SELECT trace_id, count(*) FILTER (place <= 1000) AS parts, count(*) > 1000 AS truncated, string_agg(sensitivity, ',' ORDER BY place) FILTER (place <= 3) AS first_three FROM r GROUP BY 1""")
def limited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand parts of a trace in stored order, and whether there are more (the limit is the feature)."""
    parts = events(spark, sf_dir).select("trace_id", "sequence", F.explode("content").alias("p"))
    r = parts.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy("sequence", "p.ordinal")))
    three = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "p.sensitivity"))))
    return r.groupBy("trace_id").agg(F.count_if(F.col("place") <= 1000).alias("parts"), (F.max("place") > 1000).alias("truncated"), F.array_join(F.transform(three, lambda x: x["sensitivity"]), ",").alias("first_three"))


@query("format_texts", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '—' WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 10000 THEN format('{:.1f} s', round(ms / 1000, 1)) ELSE format('{:.0f} s', round(ms / 1000)) END AS duration,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KiB', round(n / 1024, 1)) ELSE format('{:.1f} MiB', round(n / 1048576, 1)) END AS size, CASE WHEN length(i) <= 4 THEN i ELSE substr(i, 1, 4) || '…' END AS short
  FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 37 % 40000 AS ms, CAST(o_orderkey AS BIGINT) * 7919 % 5000000 AS n, CAST(o_orderkey AS VARCHAR) AS i FROM orders)""")  # fmt: skip
def format_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    ms = F.when(F.col("id") % 9 != 0, F.col("id") * 37 % 40000)
    return o.select("id", S.duration_text(ms).alias("duration"), S.bytes_text(F.col("id") * 7919 % 5_000_000).alias("size"), S.short_id(F.col("id").cast("string"), 4).alias("short"))


@query("repository_across_splits", EV + f""" SELECT sha256(concat_ws(chr(31), '{DOMAIN}.commit/v1', 'c' || (k % 33))) AS commit_ref, count(DISTINCT split) AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS names, count(DISTINCT trace_id) AS traces FROM ev WHERE split IS NOT NULL GROUP BY k % 33 HAVING count(DISTINCT split) >= 2""")
def repository_across_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits whose traces lie in several splits. Distinct pairs are counted, so a hot commit is no list."""
    ev = canonical(spark, sf_dir).where("split IS NOT NULL")
    pairs = ev.select(stable_id(F.lit(f"{DOMAIN}.commit/v1"), F.concat(F.lit("c"), (F.col("k") % 33).cast("string"))).alias("commit_ref"), "split", "trace_id").distinct()
    of = pairs.groupBy("commit_ref").agg(F.count_distinct("split").alias("splits"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("names"), F.count_distinct("trace_id").alias("traces"))
    return of.where("splits >= 2")


@query("fallback_groups", EV + f""", t AS (SELECT trace_id, max(k) % 4 = 0 AS explicit FROM ev GROUP BY 1) SELECT trace_id, CASE WHEN explicit THEN 'explicit' ELSE 'trace_fallback' END AS basis, sha256(concat_ws(chr(31), CASE WHEN explicit THEN '{DOMAIN}.group/v1' ELSE '{DOMAIN}.group/trace/v1' END, trace_id)) AS group_id FROM t""")
def fallback_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace's group, by its alias if it has one, else by itself."""
    t = canonical(spark, sf_dir).groupBy("trace_id").agg((F.max("k") % 4 == 0).alias("explicit"))
    own, alone = (stable_id(F.lit(f"{DOMAIN}.group{x}/v1"), F.col("trace_id")) for x in ("", "/trace"))
    return t.select("trace_id", F.when(F.col("explicit"), "explicit").otherwise("trace_fallback").alias("basis"), F.when(F.col("explicit"), own).otherwise(alone).alias("group_id"))


@query("edit_bookkeeping", """WITH e AS (SELECT o_custkey AS trace, o_orderkey AS ok, o_orderkey % 3 = 0 AS current FROM orders), n AS (SELECT trace, count(*) FILTER (current) AS accepted, count(*) FILTER (NOT current) AS conflicts, max(ok) FILTER (current) AS last FROM e GROUP BY 1)
  SELECT c_custkey AS trace, 1 + coalesce(accepted, 0) AS revision, coalesce(conflicts, 0) AS conflicts, CASE WHEN coalesce(accepted, 0) > 0 THEN 'pending' ELSE 'approved' END AS approval, last AS last_edit FROM customer LEFT JOIN n ON trace = c_custkey""")  # fmt: skip
def edit_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits at the expected revision (here: a third of them) raise it and take the approval back; others are conflicts."""
    edits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trace"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 3 == 0).alias("current"))
    n = edits.groupBy("trace").agg(F.count_if("current").alias("accepted"), F.count_if(~F.col("current")).alias("conflicts"), F.max(F.when(F.col("current"), F.col("at"))).alias("last_edit"))
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trace")).join(n, "trace", "left")
    zero, accepted = F.lit(0), F.coalesce("accepted", F.lit(0))
    return out.select("trace", (1 + accepted).alias("revision"), F.coalesce("conflicts", zero).alias("conflicts"), F.when(accepted > 0, "pending").otherwise("approved").alias("approval"), "last_edit")
