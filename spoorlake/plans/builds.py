"""Dataset builds: lineage digests, full gate, trace block reasons, captured messages, routes, sidecars, rebuilt reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import DOMAIN, stable_id
from ..operators import policy as P
from ..operators.digests import group_digests
from .canonical import EV, canonical
from .policy import _CLEAR, _M, _codes, manifests
from .registry import query, table

_LINE = """'{"event_type":"' || event_type || '","sequence":' || sequence || ',"status":"' || status || '"}'"""


@query("lineage_digests", EV + f""" SELECT trace_id, sha256('[' || string_agg({_LINE}, ',' ORDER BY sequence) || ']') AS digest, count(*) AS n FROM ev GROUP BY 1""")
def lineage_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each trace's canonical JSON array, streamed row by row."""
    line = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","sequence":'), F.col("sequence").cast("string"), F.lit(',"status":"'), "status", F.lit('"}'))
    return group_digests(canonical(spark, sf_dir), "trace_id", "sequence", line, ",", ("[", "]"))


#: What a gate reads beside the manifest: decision, review, competition, as expressions of the trace.
_STATE = {
    "decision": "CASE trace % 6 WHEN 0 THEN 'deny' WHEN 1 THEN 'unknown' ELSE 'allow' END", "archive": "CASE WHEN trace % 21 = 0 THEN 'deny' ELSE 'allow' END", "decision_until": "trace % 45 - 1", "withdrawn": "trace % 27 = 0", "competitive": "CASE WHEN trace % 13 = 0 THEN 'unknown' WHEN trace % 13 < 5 THEN 'yes' ELSE 'no' END",
    "automated": "CASE WHEN trace % 16 = 0 THEN 'failed' ELSE 'passed' END", "approval": "CASE WHEN trace % 18 = 0 THEN 'pending' ELSE 'approved' END", "tombstoned": "trace % 33 = 0", "basis": "CASE WHEN trace % 15 = 0 THEN 'manual-override:x' ELSE 'policy' END", "d_reviewer": "CASE WHEN trace % 30 = 0 THEN '' ELSE 'r' END", "d_evidence": "'note:sha256:' || repeat('f', 64)",
    "terms_current": "trace % 20 <> 0", "terms_matched": "trace % 22 <> 0", "terms_pinned": "trace % 24 <> 0", "terms_conflict": "trace % 26 = 0",
}
_GATE = [
    ("ACCOUNT_TYPE_UNKNOWN", "account_type = 'unknown'"), ("AUTOMATED_CHECKS_NOT_PASSED", "automated <> 'passed'"), ("COMPETITIVENESS_UNKNOWN", "competitive = 'unknown'"), ("CONSENT_INACTIVE", "NOT consent_active"), ("CONSENT_WITHDRAWN", "withdrawn"),
    ("DECISION_DENY", "decision = 'deny' OR archive = 'deny'"), ("DECISION_EXPIRED", "decision_until <= 0"), ("DECISION_UNKNOWN", "decision = 'unknown'"), ("HUMAN_APPROVAL_REQUIRED", "approval <> 'approved'"), ("MODEL_PROVIDER_UNKNOWN", "provider = 'unknown'"),
    ("NONCOMPETITIVE_DECISION_REQUIRED", "competitive <> 'no'"), ("OVERRIDE_EVIDENCE_INCOMPLETE", "basis LIKE 'manual-override:%' AND trim(d_reviewer) = ''"), ("TEACHER_MODEL_UNKNOWN", "model_id IS NULL"), ("TERMS_MISSING_OR_STALE", "NOT terms_current AND provider <> 'self_hosted'"), ("TERMS_SNAPSHOT_CONFLICT", "terms_conflict"),
    ("TERMS_SOURCE_MISMATCH", "NOT terms_matched AND provider <> 'self_hosted'"), ("TRACE_TOMBSTONED", "tombstoned"), ("TRAINING_TARGET_UNKNOWN", "target_owner IS NULL OR target_product IS NULL"),
]


def gate_codes(manual, scoped) -> list:
    """Conditions of the training gate, as (column, code), over a manifest with its state; ``manual`` and ``scoped`` tell
    whether a complete override or a scoped permission stands for the decision."""
    c = F.col
    own = c("provider") == "self_hosted"
    rights = P.rights_clear(c("license"), c("rights_basis"), c("third_party"), c("rights_holder"))
    return [
        (c("account_type") == "unknown", "ACCOUNT_TYPE_UNKNOWN"), (c("automated") != "passed", "AUTOMATED_CHECKS_NOT_PASSED"), (c("competitive") == "unknown", "COMPETITIVENESS_UNKNOWN"), (~c("consent_active"), "CONSENT_INACTIVE"), (c("withdrawn"), "CONSENT_WITHDRAWN"),
        (~P.consented(c("purposes"), P.TRAINING[0]), "CONSENT_PURPOSE_MISSING"), ((c("decision") == "deny") | (c("archive") == "deny"), "DECISION_DENY"), (c("decision_until") <= 0, "DECISION_EXPIRED"), (c("decision") == "unknown", "DECISION_UNKNOWN"), (c("approval") != "approved", "HUMAN_APPROVAL_REQUIRED"),
        (c("provider") == "unknown", "MODEL_PROVIDER_UNKNOWN"), (c("competitive") != "no", "NONCOMPETITIVE_DECISION_REQUIRED"), (F.startswith(c("basis"), F.lit("manual-override:")) & (F.trim("d_reviewer") == ""), "OVERRIDE_EVIDENCE_INCOMPLETE"), (c("model_id").isNull(), "TEACHER_MODEL_UNKNOWN"),
        (~c("terms_current") & ~own & ~scoped, "TERMS_MISSING_OR_STALE"), (~c("terms_matched") & ~own & ~scoped, "TERMS_SOURCE_MISMATCH"), (c("terms_conflict"), "TERMS_SNAPSHOT_CONFLICT"), (~c("terms_pinned") & ~own & ~manual & ~scoped, "TERMS_SNAPSHOT_UNPINNED"), (c("tombstoned"), "TRACE_TOMBSTONED"),
        (c("target_owner").isNull() | c("target_product").isNull(), "TRAINING_TARGET_UNKNOWN"), ((c("rights_basis") == "unknown"), "INPUT_RIGHTS_UNKNOWN"), ((c("third_party") == "unknown"), "THIRD_PARTY_RIGHTS_UNKNOWN"), (~P.license_known(c("license")), "SOURCE_LICENSE_UNKNOWN"),
        ((c("third_party") == "present") & ~rights, "THIRD_PARTY_CONTENT_REQUIRES_ITEMIZED_RIGHTS"), (own & ((F.size("license_chain") == 0) | F.exists("license_chain", lambda x: ~P.license_known(x))), "MODEL_LICENSE_CHAIN_UNKNOWN"),
        (~manual & ~own & ~P.trusted_teacher(), "TEACHER_SOURCE_AUTHENTICITY_UNVERIFIED"), (own & ~manual & P.trusted_self_hosted(), "SELF_HOSTED_RUNTIME_BINDING_REQUIRED"), (own & ~manual & ~P.trusted_self_hosted(), "SELF_HOSTED_PROVENANCE_UNVERIFIED"),
    ]


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in _STATE.items()])
    rows = rows.withColumns({"scoped": P.permitted(P.TRAINING[0], 0), "manual": F.startswith("basis", F.lit("manual-override:")) & (F.trim("d_reviewer") != "") & P.artifact_reference(F.col("d_evidence"))})
    return rows.withColumn("codes", P.codes(*gate_codes(F.col("manual"), F.col("scoped"))))


def _gate_sql() -> str:
    from .policy import _LICENSE, _permission_sql

    harness = "host = 'deepseek_harness' AND surface = 'harness' AND capture_method = 'instrumented_harness' AND model_id IS NOT NULL AND authenticity = 'locally_observed'"
    teacher = f"coalesce({harness} AND provider = 'deepseek' AND regexp_matches(authenticity_ref, '^native-request-header:sha256:[a-f0-9]{{64}}$'), false)"
    own = f"coalesce({harness} AND provider = 'self_hosted' AND authenticity_ref = 'local-model-artifact:' || weights_digest, false)"
    more = [
        ("CONSENT_PURPOSE_MISSING", "len(list_filter(purposes, lambda x: lower(trim(x)) IN ('training_noncompetitive', 'sft'))) = 0"), ("TERMS_SNAPSHOT_UNPINNED", "NOT terms_pinned AND provider <> 'self_hosted' AND NOT manual AND NOT scoped"), ("INPUT_RIGHTS_UNKNOWN", "rights_basis = 'unknown'"),
        ("THIRD_PARTY_RIGHTS_UNKNOWN", "third_party = 'unknown'"), ("SOURCE_LICENSE_UNKNOWN", f"NOT {_LICENSE.format('license')}"), ("THIRD_PARTY_CONTENT_REQUIRES_ITEMIZED_RIGHTS", f"third_party = 'present' AND NOT {_CLEAR}"),
        ("MODEL_LICENSE_CHAIN_UNKNOWN", f"provider = 'self_hosted' AND (len(license_chain) = 0 OR len(list_filter(license_chain, lambda x: NOT {_LICENSE.format('x')})) > 0)"), ("TEACHER_SOURCE_AUTHENTICITY_UNVERIFIED", f"NOT manual AND provider <> 'self_hosted' AND NOT {teacher}"),
        ("SELF_HOSTED_RUNTIME_BINDING_REQUIRED", f"provider = 'self_hosted' AND NOT manual AND {own}"), ("SELF_HOSTED_PROVENANCE_UNVERIFIED", f"provider = 'self_hosted' AND NOT manual AND NOT {own}"),
    ]
    pairs = [(c.replace("provider <> 'self_hosted'", "provider <> 'self_hosted' AND NOT scoped") if code in ("TERMS_MISSING_OR_STALE", "TERMS_SOURCE_MISMATCH") else c, code) for code, c in _GATE] + [(c, code) for code, c in more]
    state = ", ".join(f"{e} AS {n}" for n, e in _STATE.items())
    return f"WITH {_M}, st AS (SELECT *, {state} FROM m), sc AS (SELECT *, len({_permission_sql(P.TRAINING[0])}) = 0 AS scoped, basis LIKE 'manual-override:%' AND trim(d_reviewer) <> '' AS manual FROM st), g AS (SELECT *, {_codes(*pairs)} AS codes FROM sc)"


_GATED = _gate_sql()


@query("full_gate", _GATED + " SELECT trace, len(codes) = 0 AS allowed, array_to_string(codes, ',') AS reasons FROM g")
def full_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir).select("trace", (F.size("codes") == 0).alias("allowed"), F.array_join("codes", ",").alias("reasons"))


@query("trace_block_reasons", _GATED + """, b AS (SELECT trace, list_sort(list_distinct(list_concat(codes, list_filter(['DATASET_TARGET_MISMATCH', 'TRACE_QUALITY_FAILED', 'QUALITY_MISSING_RESULT'], lambda x: CASE x WHEN 'DATASET_TARGET_MISMATCH' THEN coalesce(target_owner, '') <> 'lab' OR coalesce(target_product, '') <> 'model' WHEN 'TRACE_QUALITY_FAILED' THEN trace % 10 = 0 ELSE trace % 4 = 1 END)))) AS codes FROM g)
  SELECT unnest(codes) AS reason, count(*) AS traces, min(trace) AS example FROM b GROUP BY 1""")  # fmt: skip
def trace_block_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, target and quality (here: made issues) of each trace as one set of reasons, counted."""
    more = P.codes((~F.col("target_owner").eqNullSafe(F.lit("lab")) | ~F.col("target_product").eqNullSafe(F.lit("model")), "DATASET_TARGET_MISMATCH"), (F.col("trace") % 10 == 0, "TRACE_QUALITY_FAILED"), (F.col("trace") % 4 == 1, "QUALITY_MISSING_RESULT"))
    return _gate(spark, sf_dir).select("trace", F.explode(F.array_union("codes", more)).alias("reason")).groupBy("reason").agg(F.count("*").alias("traces"), F.min("trace").alias("example"))


@query("captured_messages", """SELECT conv_id AS record, turn AS ordinal, CASE role WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END AS actor, 'message' AS event_type, substr(sha256(concat_ws(chr(31), 'authorized-dom', conv_id, turn)), 1, 16) AS span_id, length(text) AS chars FROM conversations WHERE length(text) > 0""")
def captured_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages (a record with its messages in order) as message events; empty messages give none."""
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("record")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return dom_events(pages)


def dom_events(pages: DataFrame) -> DataFrame:
    """``record, ordinal, actor, event_type, span_id, chars`` from ``record, messages`` (array of turn, role, text)."""
    rows = pages.select("record", F.explode("messages").alias("m")).where("length(m.text) > 0")
    actor = F.when(F.col("m.role").isin("assistant", "system"), F.col("m.role")).otherwise("user")
    span = stable_id(F.lit("authorized-dom"), F.col("record").cast("string"), F.col("m.turn").cast("string"), length=16)
    return rows.select("record", F.col("m.turn").alias("ordinal"), actor.alias("actor"), F.lit("message").alias("event_type"), span.alias("span_id"), F.length("m.text").alias("chars"))


_ENVELOPES = {
    "id": "o", "adapter": "CASE WHEN o % 19 = 0 THEN 'codex' ELSE 'browser' END", "kind": "CASE WHEN o % 17 = 0 THEN 'event' ELSE 'raw' END", "payload": "CAST(o AS STRING)", "digest": "CASE WHEN o % 13 = 0 THEN 'x' ELSE md5(CAST(o AS STRING)) END", "origin": "'https://s' || CAST(o % 3 AS STRING)", "declared_origin": "'https://s' || CAST(CASE WHEN o % 11 = 0 THEN 9 ELSE o % 3 END AS STRING)",
    "recipe": "md5(CAST(o % 4 AS STRING))", "expected_recipe": "CASE WHEN o % 23 = 0 THEN 'r' ELSE md5(CAST(o % 4 AS STRING)) END", "expires": "o % 30 - 2", "grant_ref": "CAST(o % 7 AS STRING)", "other_grant": "CASE WHEN o % 29 = 0 THEN 'no' ELSE CAST(o % 7 AS STRING) END",
}


@query("browser_envelopes", f"""WITH t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ENVELOPES.items())} FROM (SELECT CAST(o_orderkey AS BIGINT) AS o FROM orders))
  SELECT id, array_to_string({_codes(("adapter <> 'browser'", "ADAPTER"), ("kind <> 'raw'", "RECORD_KIND"), ("digest <> md5(payload)", "PAYLOAD_DIGEST"), ("origin <> declared_origin", "ORIGIN"), ("recipe <> expected_recipe", "RECIPE_DIGEST"), ("expires <= 0", "AUTHORIZATION_EXPIRED"), ("grant_ref <> other_grant", "AUTHORIZATION_MISMATCH"), ("origin = 'https://s2'", "COMMERCIAL_ORIGIN"))}, ',') AS reasons FROM t""")  # fmt: skip
def browser_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a captured envelope is refused."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o")).selectExpr(*[f"{e} AS {n}" for n, e in _ENVELOPES.items()])
    c = F.col
    found = P.codes(
        (c("adapter") != "browser", "ADAPTER"), (c("kind") != "raw", "RECORD_KIND"), (F.md5("payload") != c("digest"), "PAYLOAD_DIGEST"), (c("origin") != c("declared_origin"), "ORIGIN"), (c("recipe") != c("expected_recipe"), "RECIPE_DIGEST"),
        (c("expires") <= 0, "AUTHORIZATION_EXPIRED"), (c("grant_ref") != c("other_grant"), "AUTHORIZATION_MISMATCH"), (c("origin").isin("https://s2"), "COMMERCIAL_ORIGIN"),
    )
    return o.select("id", F.array_join(found, ",").alias("reasons"))


@query("primary_routes", EV + """, h AS (SELECT trace_id, sequence, provider || '/' || coalesce(model, '?') || CAST(k % 2 AS VARCHAR) AS route, k % 3 = 0 AS root FROM sel WHERE event_type = 'model.inference')
  SELECT trace_id, count(*) AS headers, count(DISTINCT route) AS routes, arg_min(route, CASE WHEN root THEN 0 ELSE 1000000 END + sequence) AS primary_route FROM h GROUP BY 1""")  # fmt: skip
def primary_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request headers of a trace: the primary route is that of the first root session, else of the first header."""
    h = canonical(spark, sf_dir).where("include AND event_type = 'model.inference'")
    h = h.select("trace_id", "sequence", F.concat("provider", F.lit("/"), F.coalesce("model", F.lit("?")), (F.col("k") % 2).cast("string")).alias("route"), (F.col("k") % 3 != 0).alias("inner"))
    return h.groupBy("trace_id").agg(F.count("*").alias("headers"), F.count_distinct("route").alias("routes"), F.min_by("route", F.struct("inner", "sequence")).alias("primary_route"))


@query("rebuilt_report", EV + f""", a AS (SELECT trace_id, sha256(concat_ws(chr(31), '{DOMAIN}.view/v1', trace_id, coalesce(step_id, '-'))) AS id, count(*) AS events FROM sel GROUP BY trace_id, step_id)
  SELECT CASE WHEN substr(id, 1, 1) = '0' THEN 'missing' WHEN substr(id, 1, 1) = '1' THEN 'changed' ELSE 'same' END AS verdict, count(*) AS views FROM a GROUP BY 1""")  # fmt: skip
def rebuilt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's views against those compiled again (here: the report lacks some and has some wrong)."""
    made = canonical(spark, sf_dir).where("include").groupBy("trace_id", "step_id").agg(F.count("*").alias("events"))
    made = made.select(stable_id(F.lit(f"{DOMAIN}.view/v1"), F.col("trace_id"), F.coalesce("step_id", F.lit("-"))).alias("id"), "events")
    head = F.substring("id", 1, 1)
    given = made.where(head != "0").select("id", F.when(head == "1", F.col("events") + 1).otherwise(F.col("events")).alias("reported"))
    return compare_views(made, given).groupBy("verdict").agg(F.count("*").alias("views"))


def compare_views(made: DataFrame, given: DataFrame) -> DataFrame:
    """``id, verdict``: same, changed, missing from the report, or unexpected in it."""
    both = made.join(given, "id", "full")
    verdict = F.when(F.col("reported").isNull(), "missing").when(F.col("events").isNull(), "unexpected").when(F.col("events") != F.col("reported"), "changed").otherwise("same")
    return both.select("id", verdict.alias("verdict"))


@query("dataset_card", """SELECT source, '# ' || source || chr(10) || count(*) || ' documents, ' || coalesce(sum(n_chars), 0)::BIGINT || ' characters' || chr(10) || 'languages: ' || string_agg(DISTINCT lang, ', ' ORDER BY lang) AS card FROM documents GROUP BY 1""")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's text for each source, from one aggregation."""
    langs = F.array_join(F.array_sort(F.collect_set("lang")), ", ")
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("chars"), langs.alias("langs"))
    return d.select("source", F.format_string("# %s\n%d documents, %d characters\nlanguages: %s", "source", "n", "chars", "langs").alias("card"))


@query("import_routes", """SELECT o_custkey AS import, count(DISTINCT o_orderkey % 3) AS routes, CASE WHEN count(DISTINCT o_orderkey % 3) = 1 AND min(o_orderkey % 3) = o_custkey % 3 THEN 'accepted' WHEN count(DISTINCT o_orderkey % 3) = 1 THEN 'PROVIDER_MISMATCH' ELSE 'ROUTE_NOT_SINGLE' END AS outcome FROM orders GROUP BY 1""")
def import_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import's observed route must be one, and the declared one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("import"), (F.col("o_orderkey") % 3).alias("route"))
    n = o.groupBy("import").agg(F.count_distinct("route").alias("routes"), F.min("route").alias("least"))
    outcome = F.when(F.col("routes") > 1, "ROUTE_NOT_SINGLE").when(F.col("least") != F.col("import") % 3, "PROVIDER_MISMATCH").otherwise("accepted")
    return n.select("import", "routes", outcome.alias("outcome"))


@query("imported_lineage", EV + f""", n AS (SELECT DISTINCT trace_id AS parent, substr(sha256(concat_ws(chr(31), '{DOMAIN}.import/v1', trace_id)), 1, 32) AS trace_id FROM ev) SELECT n.trace_id, n.parent, count(*) AS events, 'user_supplied' AS authenticity FROM n JOIN ev ON ev.trace_id = n.parent GROUP BY 1, 2""")
def imported_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces taken in again: a new id, the old one as parent, and authenticity lowered."""
    t = canonical(spark, sf_dir).groupBy(F.col("trace_id").alias("parent")).agg(F.count("*").alias("events"))
    return t.select(stable_id(F.lit(f"{DOMAIN}.import/v1"), F.col("parent"), length=32).alias("trace_id"), "parent", "events", F.lit("user_supplied").alias("authenticity"))
