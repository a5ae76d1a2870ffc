"""Audits that match record sets one to one, limits that fail closed, and per-trace quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from .analytics import selected
from .canonical import EV, canonical
from .dedupe import _classes, _SHINGLES
from .registry import query, table

#: Limits of the near-duplicate scan, for users who want it to fail closed as a single process would.
LIMITS = {"records": 10_000, "features_per_record": 20_000, "features_total": 500_000, "postings": 512}


@query("near_dup_limits", "WITH " + _SHINGLES + f""", p AS (SELECT s, count(*) AS m FROM f GROUP BY 1), x AS (SELECT (SELECT count(*) FROM n) AS records, (SELECT coalesce(sum(n), 0)::BIGINT FROM n) AS features, (SELECT coalesce(max(n), 0) FROM n) AS most_features, (SELECT coalesce(max(m), 0) FROM p) AS most_postings)
  SELECT *, CASE WHEN records > {LIMITS['records']} THEN 'RECORD_LIMIT' WHEN most_features > {LIMITS['features_per_record']} THEN 'FEATURES_PER_RECORD_LIMIT' WHEN features > {LIMITS['features_total']} THEN 'FEATURES_TOTAL_LIMIT' WHEN most_postings > {LIMITS['postings']} THEN 'POSTINGS_LIMIT' END AS reason_code FROM x""")  # fmt: skip
def near_dup_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a bounded scan would refuse, and why, in the order of its checks; our own join has no such limits."""
    sets = _classes(spark, sf_dir).where(F.size("features") > 0)
    # One pass: each record's size goes with a null beside its features, as no feature is null.
    rows = sets.select(F.size("features").cast("long").alias("n"), F.explode(F.array_append("features", F.lit(None).cast("long"))).alias("f"))
    counts = rows.groupBy("f").agg(F.count("*").alias("m"), F.max(F.when(F.col("f").isNull(), F.col("n"))).alias("most"))
    feature, zero = F.col("f").isNotNull(), F.lit(0).cast("long")
    both = counts.agg(
        F.coalesce(F.sum(F.when(~feature, F.col("m"))), zero).alias("records"), F.coalesce(F.sum(F.when(feature, F.col("m"))), zero).alias("features"),
        F.coalesce(F.max("most"), zero).alias("most_features"), F.coalesce(F.max(F.when(feature, F.col("m"))), zero).alias("most_postings"),
    )
    reason = (
        F.when(F.col("records") > LIMITS["records"], "RECORD_LIMIT").when(F.col("most_features") > LIMITS["features_per_record"], "FEATURES_PER_RECORD_LIMIT")
        .when(F.col("features") > LIMITS["features_total"], "FEATURES_TOTAL_LIMIT").when(F.col("most_postings") > LIMITS["postings"], "POSTINGS_LIMIT")
    )
    return both.withColumn("reason_code", reason)


def match_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, problem``: keys that are missing or extra on the right, or repeated on either side."""
    a, b = left.groupBy(key).agg(F.count("*").alias("l")), right.groupBy(key).agg(F.count("*").alias("r"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").when((F.col("l") > 1) | (F.col("r") > 1), "duplicate")
    return both.where(problem.isNotNull()).select(key, problem.alias("problem"))


@query("build_bundle_match", """WITH a AS (SELECT o_custkey AS trace, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT c_custkey AS trace, count(*) AS r FROM customer GROUP BY 1)
  SELECT CAST(coalesce(a.trace, b.trace) AS BIGINT) AS trace, CASE WHEN r IS NULL THEN 'missing' WHEN l IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem FROM a FULL JOIN b ON a.trace = b.trace WHERE r IS NULL OR l IS NULL OR l > 1 OR r > 1""")  # fmt: skip
def build_bundle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build's traces against the bundles at hand (here: orders' customers against customers)."""
    build = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("trace"))
    return match_one_to_one(build, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("trace")), "trace")


@query("label_binding", """SELECT CASE WHEN d.doc_id IS NULL THEN 'unknown_document' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'bound' END AS state, count(*) AS n FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def label_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("d"))
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l"))  # noqa: E741
    state = F.when(F.col("d").isNull(), "unknown_document").when(F.col("l").isNull(), "unlabelled").otherwise("bound")
    return d.join(l, "doc_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("train_eval_overlap", "SELECT count(*) AS shared FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)")
def train_eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 2).alias("side"))
    return d.groupBy("h").agg((F.min("side") != F.max("side")).alias("x")).agg(F.count_if("x").alias("shared"))


@query("dataset_identity", """SELECT sha256(count(*) || ':' || coalesce(sum(h), 0)) AS dataset_id, count(*) AS entries FROM (SELECT ('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 15))::UBIGINT::HUGEINT AS h FROM documents)""")
def dataset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of all entries that doesn't depend on their order: a sum of entry digests, not one long string."""
    entry = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256)
    h = F.conv(F.substring(entry, 1, 15), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(h), F.lit(0).cast("decimal(30,0)")).cast("string")
    return table(spark, sf_dir, "documents").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), total), 256).alias("dataset_id"), F.count("*").alias("entries"))


@query("freshness", """WITH f AS (SELECT doc_id, md5(text) AS h, n_chars FROM documents), now AS (SELECT doc_id, md5(CASE WHEN doc_id % 30 = 0 THEN text || '.' ELSE text END) AS h, CASE WHEN doc_id % 45 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents)
  SELECT f.doc_id, concat_ws(',', CASE WHEN f.h <> now.h THEN 'CONTENT_CHANGED' END, CASE WHEN f.n_chars <> now.n_chars THEN 'LENGTH_CHANGED' END) AS reasons FROM f JOIN now USING (doc_id) WHERE f.h <> now.h OR f.n_chars <> now.n_chars""")  # fmt: skip
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen digests against the current ones: which differ, and in what."""
    d = table(spark, sf_dir, "documents")
    frozen = d.select("doc_id", F.md5("text").alias("h"), F.col("n_chars").alias("n"))
    text = F.when(F.col("doc_id") % 30 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    now = d.select("doc_id", F.md5(text).alias("h2"), F.when(F.col("doc_id") % 45 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n2"))
    reasons = F.concat_ws(",", F.when(F.col("h") != F.col("h2"), "CONTENT_CHANGED"), F.when(F.col("n") != F.col("n2"), "LENGTH_CHANGED"))
    return frozen.join(now, "doc_id").select("doc_id", reasons.alias("reasons")).where("reasons <> ''")


@query("quality_metrics", EV + """, c AS (SELECT trace_id, call_id, count(*) FILTER (event_type = 'tool.call') AS calls, count(*) FILTER (event_type = 'tool.result') AS results FROM sel WHERE call_id IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT trace_id, sum(greatest(calls - 1, 0))::BIGINT AS duplicate_call_ids, sum(greatest(results - 1, 0))::BIGINT AS duplicate_results, count(*) FILTER (calls > 0 AND results = 0) AS dangling_calls, count(*) FILTER (calls = 0) AS orphan_results FROM c GROUP BY 1),
  e AS (SELECT trace_id, count(*) AS events, count(*) FILTER (status = 'error' OR event_type = 'error') AS errors, count(*) FILTER (status = 'partial') AS partial_events, count(*) FILTER (status = 'cancelled') AS cancelled_events, count(DISTINCT turn_id) AS turns, count(DISTINCT session_id) AS sessions FROM sel GROUP BY 1)
  SELECT e.*, coalesce(duplicate_call_ids, 0) AS duplicate_call_ids, coalesce(duplicate_results, 0) AS duplicate_results, coalesce(dangling_calls, 0) AS dangling_calls, coalesce(orphan_results, 0) AS orphan_results FROM e LEFT JOIN t USING (trace_id)""")  # fmt: skip
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    calls = ev.where("call_id IS NOT NULL").groupBy("trace_id", "call_id").agg(n("tool.call").alias("calls"), n("tool.result").alias("results"))
    more = lambda c: F.sum(F.greatest(F.col(c) - 1, F.lit(0)))
    calls = calls.groupBy("trace_id").agg(
        more("calls").alias("duplicate_call_ids"), more("results").alias("duplicate_results"), F.count_if((F.col("calls") > 0) & (F.col("results") == 0)).alias("dangling_calls"), F.count_if(F.col("calls") == 0).alias("orphan_results")
    )
    whole = ev.groupBy("trace_id").agg(
        F.count("*").alias("events"), F.count_if((F.col("status") == "error") | (F.col("event_type") == "error")).alias("errors"), F.count_if(F.col("status") == "partial").alias("partial_events"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_events"), F.countDistinct("turn_id").alias("turns"), F.countDistinct("session_id").alias("sessions"),
    )
    return whole.join(calls, "trace_id", "left").na.fill(0)


@query("quality_issues", EV + """, c AS (SELECT trace_id, call_id, count(*) FILTER (event_type = 'tool.call') AS calls, count(*) FILTER (event_type = 'tool.result') AS results FROM sel WHERE call_id IS NOT NULL GROUP BY 1, 2)
  SELECT trace_id, 'DUPLICATE_TOOL_CALL_ID' AS code, 'error' AS severity, count(*) AS n FROM c WHERE calls > 1 GROUP BY 1 UNION ALL SELECT trace_id, 'DANGLING_TOOL_CALL', 'error', count(*) FROM c WHERE calls > 0 AND results = 0 GROUP BY 1
  UNION ALL SELECT trace_id, 'ORPHAN_TOOL_RESULT', 'error', count(*) FROM c WHERE calls = 0 GROUP BY 1 UNION ALL SELECT trace_id, 'PARTIAL_EVENTS_PRESENT', 'warning', count(*) FROM sel WHERE status = 'partial' GROUP BY 1
  UNION ALL SELECT trace_id, 'CANCELLED_EVENTS_PRESENT', 'warning', count(*) FROM sel WHERE status = 'cancelled' GROUP BY 1""")  # fmt: skip
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = selected(spark, sf_dir)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    calls = ev.where("call_id IS NOT NULL").groupBy("trace_id", "call_id").agg(n("tool.call").alias("calls"), n("tool.result").alias("results"))
    codes = lambda *pairs: F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for c, code, s in pairs]), lambda x: x.isNotNull())
    one = calls.select("trace_id", F.explode(codes((F.col("calls") > 1, "DUPLICATE_TOOL_CALL_ID", "error"), ((F.col("calls") > 0) & (F.col("results") == 0), "DANGLING_TOOL_CALL", "error"), (F.col("calls") == 0, "ORPHAN_TOOL_RESULT", "error"))).alias("x"))
    two = ev.select("trace_id", F.explode(codes((F.col("status") == "partial", "PARTIAL_EVENTS_PRESENT", "warning"), (F.col("status") == "cancelled", "CANCELLED_EVENTS_PRESENT", "warning"))).alias("x"))
    return one.union(two).groupBy("trace_id", "x.code", "x.severity").agg(F.count("*").alias("n"))


@query("reviewer_metrics", EV + """ SELECT coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(*) FILTER (event_type = 'tool.call') AS calls,
  least(count(*) FILTER (event_type = 'tool.call'), count(*) FILTER (event_type = 'tool.result')) AS paired, count(*) FILTER (event_type = 'evaluation') AS verifications FROM ev""")  # fmt: skip
def reviewer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage over all events (not the last of each round) and counts."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return canonical(spark, sf_dir).agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), n("tool.call").alias("calls"), F.least(n("tool.call"), n("tool.result")).alias("paired"), n("evaluation").alias("verifications"))


@query("status_report", EV + " SELECT status, coalesce(split, 'none') AS split, count(*) AS n FROM ev GROUP BY 1, 2")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, sf_dir).groupBy("status", F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"))


@query("session_forward_fill", EV + """ SELECT trace_id, sequence, last_value(session_id IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY sequence) AS session, last_value(call_id IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY sequence) AS last_call FROM ev""")
def session_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    fill = lambda c: S.forward_fill(F.col(c), ["trace_id"], ["sequence"])
    return canonical(spark, sf_dir).select("trace_id", "sequence", fill("session_id").alias("session"), fill("call_id").alias("last_call"))


@query("tool_index_in_round", EV + """ SELECT trace_id, sequence, row_number() OVER (PARTITION BY trace_id, turn_id, step_id ORDER BY sequence) - 1 AS tool_index FROM sel WHERE event_type = 'tool.call' AND step_id IS NOT NULL""")
def tool_index_in_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("trace_id", "turn_id", "step_id").orderBy("sequence")
    calls = selected(spark, sf_dir).where("event_type = 'tool.call' AND step_id IS NOT NULL")
    return calls.select("trace_id", "sequence", (F.row_number().over(w) - 1).cast("long").alias("tool_index"))


@query("monotonic_violations", EV + """, s AS (SELECT trace_id, event_id, CASE WHEN k % 29 = 0 THEN sequence - 2 ELSE sequence END AS stored, sequence FROM ev), l AS (SELECT *, lag(stored) OVER (PARTITION BY trace_id ORDER BY sequence) AS before FROM s)
  SELECT trace_id, count(*) AS violations FROM l WHERE stored <= before GROUP BY 1""")  # fmt: skip
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that don't rise in the stored order (here: some numbers are disturbed)."""
    ev = canonical(spark, sf_dir).withColumn("stored", F.when(F.col("k") % 29 == 0, F.col("sequence") - 2).otherwise(F.col("sequence")))
    before = F.lag("stored").over(Window.partitionBy("trace_id").orderBy("sequence"))
    return ev.withColumn("before", before).where("stored <= before").groupBy("trace_id").agg(F.count("*").alias("violations"))


@query("artifact_difference", """WITH a AS (SELECT p_partkey AS k FROM part), b AS (SELECT l_partkey AS k FROM lineitem) SELECT 'unlisted' AS kind, count(*) AS n FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT 'absent', count(*) FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)""")
def artifact_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder against those of an inventory, both ways, repeats counted (here: parts and line items)."""
    a, b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    both = a.groupBy("k").agg(F.count("*").alias("a")).join(b.groupBy("k").agg(F.count("*").alias("b")), "k", "full_outer").na.fill(0, ["a", "b"])
    gone = both.agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("unlisted"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("absent"))
    return gone.select(F.explode(F.array(F.struct(F.lit("unlisted").alias("kind"), F.coalesce("unlisted", F.lit(0)).alias("n")), F.struct(F.lit("absent").alias("kind"), F.coalesce("absent", F.lit(0)).alias("n")))).alias("x")).select("x.*")
