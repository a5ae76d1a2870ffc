"""Policy queries over synthetic manifests (one a customer), each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy as P
from .registry import query, table

#: Columns of a manifest as expressions of k that both engines read; lists are comma-separated until split.
_FIELDS = {
    "trace": "k",
    "provider": "CASE k % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'deepseek' WHEN 3 THEN 'self_hosted' ELSE 'unknown' END",
    "account_type": "CASE k % 6 WHEN 0 THEN 'consumer' WHEN 1 THEN 'api' WHEN 2 THEN 'business' WHEN 3 THEN 'self_hosted' WHEN 4 THEN 'enterprise' ELSE 'unknown' END",
    "capture_method": "CASE k % 8 WHEN 0 THEN 'official_stream' WHEN 1 THEN 'official_hook' WHEN 2 THEN 'official_export' WHEN 3 THEN 'manual_copy' WHEN 4 THEN 'authorized_dom' WHEN 6 THEN 'official_stream' ELSE 'instrumented_harness' END",
    "surface": "CASE WHEN k % 8 IN (5, 7) THEN 'harness' WHEN k % 8 = 4 OR k % 9 = 0 THEN 'web' ELSE 'cli' END",
    "host": "CASE WHEN k % 8 IN (5, 7) THEN 'deepseek_harness' WHEN k % 3 = 0 THEN 'codex' WHEN k % 3 = 1 THEN 'claude_code' ELSE 'browser' END",
    "origin": "CASE WHEN k % 8 = 4 THEN CASE WHEN k % 3 = 0 THEN 'HTTPS://Site' || CAST(k % 4 AS STRING) || '.example.com:443/x' WHEN k % 3 = 1 THEN 'site' ELSE 'http://site1.example.com' END END",
    "authenticity": "CASE WHEN k % 10 < 7 THEN 'locally_observed' WHEN k % 10 = 7 THEN 'user_authorized_observation' ELSE 'user_supplied' END",
    "model_id": "CASE WHEN k % 11 <> 0 THEN 'model-' || CAST(k % 3 AS STRING) END",
    "authenticity_ref": "CASE WHEN k % 5 = 3 THEN 'local-model-artifact:sha256:' || repeat('b', 64) WHEN k % 4 <> 0 THEN 'native-request-header:sha256:' || repeat('a', 64) END",
    "weights_digest": "CASE WHEN k % 7 < 5 THEN 'sha256:' || repeat('b', 64) END",
    "consent_active": "k % 13 <> 0",
    "purposes": "CASE k % 5 WHEN 0 THEN 'archive, SFT ' WHEN 1 THEN 'capture,Distillation' WHEN 2 THEN 'archive,release' WHEN 3 THEN '' ELSE 'training_noncompetitive,archive' END",
    "written_ref": "CASE WHEN k % 17 = 0 THEN 'contract:sha256:' || repeat('c', 64) END",
    "target_owner": "CASE WHEN k % 12 <> 0 THEN 'lab' END",
    "target_product": "CASE WHEN k % 14 <> 0 THEN 'model' END",
    "license": "CASE k % 7 WHEN 0 THEN 'mit ' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'NOASSERTION' WHEN 3 THEN 'CC-BY-4.0' WHEN 4 THEN 'ISC' WHEN 5 THEN 'MIT' ELSE '' END",
    "rights_basis": "CASE k % 4 WHEN 0 THEN 'owned' WHEN 1 THEN 'licensed' WHEN 2 THEN 'consented' ELSE CASE WHEN k % 5 = 0 THEN 'unknown' ELSE 'owned' END END",
    "third_party": "CASE WHEN k % 6 = 1 THEN 'present' WHEN k % 19 = 0 THEN 'unknown' ELSE 'none' END",
    "rights_holder": "CASE WHEN k % 2 = 1 THEN 'holder' ELSE ' ' END",
    "license_chain": "CASE WHEN k % 3 = 0 THEN '' WHEN k % 4 = 0 THEN 'MIT,UNKNOWN' ELSE 'MIT,Apache-2.0' END",
    "p_ref": "CASE WHEN k % 3 <> 2 THEN CASE WHEN k % 23 = 0 THEN 'bad' WHEN k % 34 = 0 THEN 'contract:sha256:' || repeat('d', 64) ELSE 'contract:sha256:' || repeat('c', 64) END END",
    "p_reviewer": "CASE WHEN k % 29 = 0 THEN ' ' ELSE 'reviewer' END",
    "p_provider": "CASE WHEN k % 31 = 0 THEN 'unknown' WHEN k % 37 = 0 THEN 'openai' ELSE CASE k % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'deepseek' WHEN 3 THEN 'self_hosted' ELSE 'unknown' END END",
    "p_account": "CASE WHEN k % 41 = 0 THEN 'api' ELSE CASE k % 6 WHEN 0 THEN 'consumer' WHEN 1 THEN 'api' WHEN 2 THEN 'business' WHEN 3 THEN 'self_hosted' WHEN 4 THEN 'enterprise' ELSE 'unknown' END END",
    "p_methods": "CASE WHEN k % 10 = 0 THEN 'official_hook' ELSE 'official_stream,official_hook,authorized_dom,instrumented_harness' END",
    "p_origins": "CASE WHEN k % 8 = 4 THEN 'https://site0.example.com,https://site1.example.com/' ELSE CASE WHEN k % 43 = 0 THEN 'https://x.example.com' ELSE '' END END",
    "p_purposes": "CASE k % 4 WHEN 0 THEN 'automatic_capture' WHEN 1 THEN 'automatic_capture,training_noncompetitive,training_competitive_distillation' WHEN 2 THEN 'redistribution' ELSE 'training_noncompetitive,redistribution' END",
    "p_from": "k % 50 - 45",
    "p_until": "k % 60 - 3",
    "p_owner": "CASE WHEN k % 4 <> 0 THEN 'lab' END",
    "p_product": "CASE WHEN k % 4 <> 0 THEN 'model' END",
}
_LISTS = ("purposes", "license_chain", "p_methods", "p_origins", "p_purposes")
_M = "m AS (SELECT " + ", ".join(f"list_filter(string_split({e}, ','), lambda x: x <> '') AS {n}" if n in _LISTS else f"{e} AS {n}" for n, e in _FIELDS.items()) + " FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer))"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    rows = k.selectExpr("k", *[f"{e} AS {n}" for n, e in _FIELDS.items()])
    return rows.withColumns({n: F.filter(F.split(n, ","), lambda x: x != "") for n in _LISTS})


_joined = lambda c: F.array_join(c, ",")
_NOW = 0


def _codes(*pairs: tuple[str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in pairs) + "], lambda x: x IS NOT NULL))"


_ORIGIN = "nullif(CASE WHEN lower(trim({0})) LIKE 'https:%' THEN regexp_replace(regexp_extract(lower(trim({0})), '^(https?://[^/?#@:]+(:[0-9]+)?)([/?#].*)?$', 1), ':443$', '') ELSE regexp_replace(regexp_extract(lower(trim({0})), '^(https?://[^/?#@:]+(:[0-9]+)?)([/?#].*)?$', 1), ':80$', '') END, '')"
_KINDS = ("automatic_capture", *P.TRAINING, "redistribution")
_REF = "coalesce(regexp_matches({0}, '^[a-z][a-z0-9]*([._-][a-z0-9]+)*:sha256:[a-f0-9]{{64}}$') AND strpos({0}, ':sha256:') <= 65, false)"


def _permission_sql(purpose: str) -> str:
    named, other = "(p_owner IS NOT NULL OR p_product IS NOT NULL)", "(p_owner IS DISTINCT FROM target_owner OR p_product IS DISTINCT FROM target_product)"
    target = f"(target_owner IS NULL OR target_product IS NULL OR {other})" if purpose in P.TRAINING else named if purpose == "automatic_capture" else f"({named} AND {other})"
    o = f"({_ORIGIN.format('origin')})"
    found = _codes(
        (f"NOT {_REF.format('p_ref')}", "SCOPED_PERMISSION_EVIDENCE_REFERENCE_INVALID"), ("trim(p_reviewer) = ''", "SCOPED_PERMISSION_REVIEWER_MISSING"), ("written_ref <> p_ref", "SCOPED_PERMISSION_REFERENCE_MISMATCH"),
        ("'unknown' IN (provider, p_provider)", "SCOPED_PERMISSION_PROVIDER_UNKNOWN"), ("'unknown' NOT IN (provider, p_provider) AND provider <> p_provider", "SCOPED_PERMISSION_PROVIDER_MISMATCH"),
        ("'unknown' IN (account_type, p_account)", "SCOPED_PERMISSION_ACCOUNT_UNKNOWN"), ("'unknown' NOT IN (account_type, p_account) AND account_type <> p_account", "SCOPED_PERMISSION_ACCOUNT_MISMATCH"),
        ("NOT list_contains(p_methods, capture_method)", "SCOPED_PERMISSION_CAPTURE_METHOD_MISMATCH"),
        (f"CASE WHEN {o} IS NULL THEN origin IS NOT NULL OR len(p_origins) > 0 ELSE NOT list_contains(list_transform(p_origins, lambda x: {_ORIGIN.format('x')}), {o}) END", "SCOPED_PERMISSION_ORIGIN_MISMATCH"),
        (f"NOT list_contains(p_purposes, '{purpose}')", "SCOPED_PERMISSION_PURPOSE_MISMATCH"), ("p_from > 0", "SCOPED_PERMISSION_NOT_YET_EFFECTIVE"), ("p_until <= 0 OR p_until <= p_from", "SCOPED_PERMISSION_EXPIRED"),
        (target, "SCOPED_PERMISSION_TARGET_MISMATCH"),
    )
    return f"CASE WHEN p_ref IS NULL THEN ['SCOPED_PERMISSION_REQUIRED'] ELSE {found} END"


_PERMISSIONS = f"WITH {_M}, p AS (SELECT *, " + ", ".join(f"{_permission_sql(x)} AS why_{x}" for x in _KINDS) + " FROM m)"


@query("permission_evidence", _PERMISSIONS + " " + " UNION ALL ".join(f"SELECT trace, '{x}' AS purpose, array_to_string(why_{x}, ',') AS reasons FROM p" for x in _KINDS))
def permission_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.struct(F.lit(x).alias("purpose"), _joined(P.permission_reasons(x, _NOW)).alias("reasons")) for x in _KINDS]
    return manifests(spark, sf_dir).select("trace", F.explode(F.array(*each)).alias("e")).select("trace", "e.*")


_LICENSE = "upper(trim({0})) IN (" + ", ".join(f"'{x}'" for x in P.LICENSES) + ")"
_CLEAR = f"({_LICENSE.format('license')} AND rights_basis <> 'unknown' AND third_party <> 'unknown' AND (third_party <> 'present' OR (rights_basis IN ('licensed', 'consented', 'public_domain') AND trim(rights_holder) <> '')))"


@query("rights_clear", f"WITH {_M} SELECT rights_basis, third_party, count(*) AS traces, count(*) FILTER ({_CLEAR}) AS clear FROM m GROUP BY ALL")
def rights_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    clear = P.rights_clear(F.col("license"), F.col("rights_basis"), F.col("third_party"), F.col("rights_holder"))
    return manifests(spark, sf_dir).groupBy("rights_basis", "third_party").agg(F.count("*").alias("traces"), F.count_if(clear).alias("clear"))


def _eligibility_sql() -> str:
    harness = "host = 'deepseek_harness' AND surface = 'harness' AND capture_method = 'instrumented_harness' AND model_id IS NOT NULL AND authenticity = 'locally_observed'"
    teacher = f"coalesce({harness} AND provider = 'deepseek' AND regexp_matches(authenticity_ref, '^native-request-header:sha256:[a-f0-9]{{64}}$'), false)"
    own = f"coalesce({harness} AND provider = 'self_hosted' AND authenticity_ref = 'local-model-artifact:' || weights_digest, false)"
    auto = f"""CASE WHEN capture_method IN ('official_export', 'manual_copy') THEN 'deny:MANUAL_PATH_NOT_AUTOMATIC' WHEN capture_method = 'authorized_dom' THEN 'unknown:SITE_AUTHORIZATION_REQUIRED' WHEN len(why_automatic_capture) = 0 THEN 'allow:SCOPED_AUTOMATIC_CAPTURE_PERMISSION'
      WHEN own AND account_type = 'self_hosted' THEN 'allow:SELF_HOSTED_AUTHORITY' WHEN surface = 'web' THEN 'deny:COMMERCIAL_WEB_AUTOMATION_BLOCKED' WHEN provider = 'openai' AND account_type = 'consumer' THEN 'deny:OPENAI_CONSUMER_AUTOMATED_EXTRACTION'
      WHEN provider = 'anthropic' AND account_type = 'consumer' THEN 'deny:ANTHROPIC_CONSUMER_AUTOMATED_ACCESS' WHEN account_type IN ('api', 'business', 'enterprise') THEN 'allow:OFFICIAL_MACHINE_INTERFACE' ELSE 'unknown:ACCOUNT_OR_CONTRACT_UNKNOWN' END"""

    def training(mode: str, scoped: str, allowed: str, first: str, second: str) -> str:
        return f"""CASE WHEN consent_active AND teacher AND len(why_{mode}) = 0 THEN 'allow:{scoped}' WHEN NOT consent_active OR NOT clear THEN 'unknown:CONSENT_OR_RIGHTS_INCOMPLETE' WHEN written_ref IS NOT NULL THEN 'unknown:SCOPED_TRAINING_OVERRIDE_REQUIRED'
          WHEN teacher AND auto LIKE 'allow:%' THEN 'allow:{allowed}' WHEN own AND account_type = 'self_hosted' THEN 'unknown:SELF_HOSTED_RUNTIME_BINDING_REQUIRED' WHEN provider = 'openai' THEN '{first}' WHEN provider = 'anthropic' THEN '{second}' ELSE 'unknown:TRAINING_PERMISSION_UNKNOWN' END"""

    noncompetitive = training("training_noncompetitive", "SCOPED_NONCOMPETITIVE_TRAINING_PERMISSION", "DEEPSEEK_OUTPUT_TRAINING_ALLOWED", "unknown:OPENAI_PERMITTED_EXCEPTION_NOT_ESTABLISHED", "unknown:ANTHROPIC_NONCOMPETITIVE_SCOPE_NOT_ESTABLISHED")
    competitive = training("training_competitive_distillation", "SCOPED_COMPETITIVE_TRAINING_PERMISSION", "DEEPSEEK_DISTILLATION_ALLOWED", "deny:OPENAI_COMPETITIVE_MODEL_TRAINING", "deny:ANTHROPIC_COMPETITIVE_MODEL_TRAINING")
    clear = f"({_CLEAR} AND (provider <> 'self_hosted' OR (len(license_chain) > 0 AND len(list_filter(license_chain, lambda x: NOT {_LICENSE.format('x')})) = 0)))"
    return f"""{_PERMISSIONS}, t AS (SELECT *, {teacher} AS teacher, {own} AS own, {clear} AS clear FROM p), a AS (SELECT *, {auto} AS auto FROM t),
  e AS (SELECT trace, CASE WHEN consent_active THEN 'allow:EXPLICIT_LOCAL_ARCHIVE_CONSENT' ELSE 'deny:CONSENT_INACTIVE' END AS archive, auto AS automatic_capture, {noncompetitive} AS training_noncompetitive, {competitive} AS training_competitive_distillation,
    CASE WHEN consent_active AND len(why_redistribution) = 0 THEN 'allow:SCOPED_REDISTRIBUTION_PERMISSION' WHEN upper(trim(license)) IN ('MIT', 'APACHE-2.0', 'CC0-1.0') THEN 'allow:REDISTRIBUTABLE_SOURCE_LICENSE' ELSE 'unknown:REDISTRIBUTION_NOT_ESTABLISHED' END AS redistribution, purposes FROM a)"""


_ELIGIBILITY = _eligibility_sql()


def _eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.default_eligibility(_NOW)
    return manifests(spark, sf_dir).select("trace", "purposes", *[F.concat_ws(":", d["status"], d["code"]).alias(mode) for mode, d in made.items()])


@query("automatic_capture", _ELIGIBILITY + " SELECT automatic_capture, count(*) AS traces FROM e GROUP BY 1")
def automatic_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligibility(spark, sf_dir).groupBy("automatic_capture").agg(F.count("*").alias("traces"))


@query("gate_explain", _ELIGIBILITY + " SELECT * EXCLUDE (purposes) FROM e")
def gate_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes' decisions side by side."""
    return _eligibility(spark, sf_dir).drop("purposes")


@query("consent_purposes", f"WITH {_M} SELECT trace, " + ", ".join("len(list_filter(purposes, lambda x: lower(trim(x)) IN (" + ", ".join(f"'{n}'" for n in names) + f"))) > 0 AS {mode}" for mode, names in P.PURPOSES.items()) + " FROM m")
def consent_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests(spark, sf_dir).select("trace", *[P.consented(F.col("purposes"), mode).alias(mode) for mode in P.PURPOSES])


_TERMS_REGISTRY = [("openai", a, "https://Openai.example.com/terms/", ["AA", "bb"]) for a in ("consumer", "api", "business")] + [("anthropic", a, u, d) for a in ("api", "business", "enterprise") for u, d in (("https://anthropic.example.com/terms", ["aa"]), ("https://anthropic.example.com/use//", ["cc"]))] + [("deepseek", "api", "https://deepseek.example.com/terms", [])]
#: Terms from orders: one for each order, its customer's provider naming the site.
_TERM = {
    "trace": "ck", "name": "CASE WHEN ok % 3 = 0 THEN 'terms' ELSE 'use' END", "effective_at": "ok % 4 - 3", "retrieved_at": "ok % 7 - 6", "review_after": "ok % 90 + 0",
    "snapshot": "CASE ok % 5 WHEN 0 THEN 'AA' WHEN 1 THEN 'bb' WHEN 2 THEN 'cc' ELSE 'aa' END",
    "url": "'https://' || CASE ck % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'deepseek' END || '.Example.com/' || CASE WHEN ok % 3 = 0 THEN 'terms/' ELSE 'use' END",
}
_REG = ", ".join(f"('{p}', '{a}', '{u}', [{', '.join(repr(x) for x in d)}]::VARCHAR[])" for p, a, u, d in _TERMS_REGISTRY)


@query("terms_checks", f"""WITH {_M}, reg(provider, account_type, url, accepted) AS (VALUES {_REG}), t0 AS (SELECT CAST(o_custkey AS BIGINT) AS ck, CAST(o_orderkey AS BIGINT) AS ok FROM orders), t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _TERM.items())} FROM t0),
  u AS (SELECT *, lower(regexp_replace(url, '/+$', '')) AS u FROM t), f AS (SELECT trace, bool_and(effective_at <= 0 AND retrieved_at <= 0 AND review_after > 0) AS fresh FROM t GROUP BY 1),
  c AS (SELECT trace, max(n) > 1 AS conflicting FROM (SELECT trace, name, u, effective_at, count(DISTINCT snapshot) AS n FROM u GROUP BY ALL) GROUP BY 1),
  r AS (SELECT m.trace, bool_and(EXISTS (SELECT 1 FROM u WHERE u.trace = m.trace AND u.u = lower(regexp_replace(reg.url, '/+$', '')))) AS seen,
    bool_and(EXISTS (SELECT 1 FROM u WHERE u.trace = m.trace AND u.u = lower(regexp_replace(reg.url, '/+$', '')) AND list_contains(list_transform(accepted, lambda x: lower(x)), lower(u.snapshot)))) AS held FROM m JOIN reg ON reg.provider = m.provider AND reg.account_type = m.account_type GROUP BY 1)
  SELECT m.trace, provider = 'self_hosted' OR coalesce(fresh, false) AS current, provider = 'self_hosted' OR coalesce(seen, false) AS matched, provider = 'self_hosted' OR coalesce(held, false) AS pinned, coalesce(conflicting, false) AS conflicting
  FROM m LEFT JOIN f ON f.trace = m.trace LEFT JOIN c ON c.trace = m.trace LEFT JOIN r ON r.trace = m.trace""")  # fmt: skip
def terms_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("ck"), F.col("o_orderkey").cast("long").alias("ok"))
    terms = o.selectExpr(*[f"{e} AS {n}" for n, e in _TERM.items()])
    registry = spark.createDataFrame(_TERMS_REGISTRY, "provider string, account_type string, url string, accepted array<string>")
    return P.terms_checks(terms, registry, manifests(spark, sf_dir).select("trace", "provider", "account_type"), _NOW)


_ATTEST = {
    "trace": "ck", "event": "ok", "event_sha256": "md5(CAST(ok AS STRING))", "source_sha256": "md5(CAST(ck AS STRING))", "a_event": "CASE WHEN ok % 4 <> 0 THEN CASE WHEN ok % 9 = 0 THEN 'changed' ELSE md5(CAST(ok AS STRING)) END END",
    "a_source": "CASE WHEN ok % 11 = 0 THEN NULL ELSE md5(CAST(ck AS STRING)) END", "a_at": "ok % 20 - 18", "a_until": "ok % 30 - 2", "a_rights": "CASE WHEN ok % 2 = 0 THEN 'x' ELSE 'y' END", "target_owner": "'lab'", "target_product": "CASE WHEN ok % 6 <> 0 THEN 'model' END",
}


@query("rights_attestation", f"""WITH t0 AS (SELECT CAST(o_custkey AS BIGINT) AS ck, CAST(o_orderkey AS BIGINT) AS ok FROM orders), t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ATTEST.items())}, ok FROM t0),
  r AS (SELECT trace, event, CASE WHEN a_event IS NULL THEN ['RIGHTS_ATTESTATION_REQUIRED'] ELSE {_codes(("a_event IS DISTINCT FROM event_sha256", "RIGHTS_ATTESTATION_EVENT_CHANGED"), ("a_source IS DISTINCT FROM source_sha256", "RIGHTS_ATTESTATION_SOURCE_CHANGED"), ("a_at > 0", "RIGHTS_ATTESTATION_NOT_YET_VALID"), ("a_until <= 0", "RIGHTS_ATTESTATION_EXPIRED"), ("NOT ((ok % 5 <> 0 AND coalesce(target_product, '') = 'model') OR (ok % 5 = 1 AND target_product IS NULL))", "RIGHTS_ATTESTATION_SCOPE_MISMATCH"), ("ok % 7 < 2 AND a_rights <> 'x'", "RIGHTS_ATTESTATION_CONTENT_MISMATCH"))} END AS codes FROM t)
  SELECT trace, event, array_to_string(codes, ',') AS reasons FROM r""")  # fmt: skip
def rights_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("ck"), F.col("o_orderkey").cast("long").alias("ok"))
    rows = o.selectExpr("ok", *[f"{e} AS {n}" for n, e in _ATTEST.items()])
    scope = lambda mode, product: F.struct(F.lit(mode).alias("mode"), F.lit("lab").alias("owner"), F.lit(product).cast("string").alias("product"))
    scopes = F.when(F.col("ok") % 5 == 0, F.array(scope("redistribution", "model"))).when(F.col("ok") % 5 == 1, F.array(scope(P.TRAINING[0], "model"), scope(P.TRAINING[0], None))).otherwise(F.array(scope(P.TRAINING[0], "model")))
    rows = rows.withColumns({"a_scopes": scopes, "overrides": F.array(F.lit(None).cast("string"), F.when(F.col("ok") % 7 < 2, "x"))})
    return rows.select("trace", "event", _joined(P.attestation_reasons(P.TRAINING[0], _NOW)).alias("reasons"))


_APPROVAL = {
    "trace": "k", "bundle_sha256": "md5(CAST(k AS STRING))", "reviewer": "CASE WHEN k % 8 <> 0 THEN 'r' || CAST(k % 3 AS STRING) END", "reviewed_at": "k % 5", "notes": "CASE WHEN k % 9 <> 0 THEN 'n' || CAST(k % 4 AS STRING) ELSE '' END", "human_approval": "CASE WHEN k % 6 = 0 THEN 'pending' ELSE 'approved' END",
    "decision_id": "'d' || CAST(k % 10 AS STRING)", "target_owner": "'lab'", "target_product": "CASE WHEN k % 4 <> 0 THEN 'model' END", "s_bundle": "CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 11 = 0 THEN 'old' ELSE md5(CAST(k AS STRING)) END END", "s_reviewer": "'r' || CAST(k % 3 AS STRING)",
    "s_time": "CASE WHEN k % 13 = 0 THEN 9 ELSE k % 5 END", "s_decision": "CASE WHEN k % 5 <> 0 THEN 'd' || CAST(k % 10 AS STRING) END", "s_owner": "'lab'", "s_product": "CASE WHEN k % 3 <> 0 THEN 'model' END",
}


@query("approval_scope", f"""WITH t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _APPROVAL.items())} FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer)), s AS (SELECT *, s_bundle IS NOT NULL AS scoped, reviewer IS NOT NULL AND notes <> '' AS known, CASE WHEN trace % 17 = 0 THEN 'x' ELSE sha256(notes) END AS s_notes FROM t)
  SELECT trace, array_to_string({_codes(("human_approval <> 'approved'", "HUMAN_APPROVAL_REQUIRED"), ("NOT scoped", "APPROVAL_SCOPE_REQUIRED"), ("s_bundle <> bundle_sha256", "APPROVAL_CONTENT_CHANGED"), ("scoped AND NOT known", "APPROVAL_PROVENANCE_REQUIRED"), ("scoped AND known AND s_reviewer <> reviewer", "APPROVAL_REVIEWER_CHANGED"), ("scoped AND known AND s_time <> reviewed_at", "APPROVAL_TIME_CHANGED"), ("scoped AND known AND s_notes <> sha256(notes)", "APPROVAL_NOTES_CHANGED"), ("scoped AND s_decision IS NULL", "APPROVAL_MODE_NOT_APPROVED"), ("scoped AND s_decision <> decision_id", "APPROVAL_DECISION_CHANGED"), ("scoped AND s_decision IS NOT NULL AND s_product IS DISTINCT FROM target_product", "APPROVAL_TARGET_CHANGED"))}, ',') AS reasons FROM s""")  # fmt: skip
def approval_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    rows = k.selectExpr(*[f"{e} AS {n}" for n, e in _APPROVAL.items()]).withColumn("s_notes", F.when(F.col("trace") % 17 == 0, "x").otherwise(F.sha2("notes", 256)))
    return rows.select("trace", _joined(P.approval_reasons()).alias("reasons"))


_RAW = {
    "trace": "u", "ordinal": "e", "sequence": "n - CASE WHEN u % 5 = 0 AND n > 3 THEN 1 ELSE 0 END + CASE WHEN u % 7 = 0 AND n > 4 THEN 2 ELSE 0 END", "adapter": "CASE WHEN u % 11 = 0 AND n = 2 THEN 'browser' ELSE 'codex' END",
    "interface_version": "CASE WHEN u % 3 = 0 AND n = 1 THEN 'codex-hook/1' WHEN u % 13 = 0 AND n = 0 THEN 'codex-hook/9' ELSE 'codex-exec-jsonl/1' END", "adapter_version": "CASE WHEN u % 17 = 0 AND n = 1 THEN '2' ELSE '1' END", "payload": "CAST(e AS STRING)",
}
_RAW_SQL = f"""WITH e0 AS (SELECT CAST(user_id AS BIGINT) AS u, CAST(event_id AS BIGINT) AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), r AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _RAW.items())}, sha256(CASE WHEN u % 19 = 0 AND n = 0 THEN 'x' ELSE CAST(e AS STRING) END) AS payload_sha256 FROM e0),
  l AS (SELECT *, lag(sequence) OVER (PARTITION BY trace ORDER BY ordinal) AS before FROM r),
  g AS (SELECT trace, bool_or(sequence <= before) AS falls, bool_or(adapter <> 'codex') AS adapter, bool_or(NOT ((adapter = 'codex' AND interface_version IN ('codex-exec-jsonl/1', 'codex-hook/1')) OR (adapter = 'browser' AND interface_version = 'authorized-dom/0.1'))) AS interface, bool_or(sha256(payload) <> payload_sha256) AS digest,
    count(*) > count(DISTINCT sequence) AS twice, NOT list_sort(list_distinct(list(sequence))) = range(CAST(count(DISTINCT sequence) AS BIGINT)) AS gap, string_agg(DISTINCT interface_version, '+' ORDER BY interface_version) <> 'codex-exec-jsonl/1' AS versions, string_agg(DISTINCT adapter_version, '+' ORDER BY adapter_version) <> '1' AS adapters FROM l GROUP BY 1)
  SELECT trace, array_to_string({_codes(("falls", "RAW_SEQUENCE_NON_MONOTONIC"), ("adapter", "RAW_ADAPTER_MISMATCH"), ("interface", "RAW_INTERFACE_UNSUPPORTED"), ("digest", "RAW_PAYLOAD_HASH_MISMATCH"), ("gap", "RAW_SEQUENCE_GAP"), ("twice", "RAW_SEQUENCE_DUPLICATE"), ("versions", "RAW_INTERFACE_MANIFEST_MISMATCH"), ("adapters", "RAW_ADAPTER_VERSION_MANIFEST_MISMATCH"))}, ',') AS reasons FROM g"""  # fmt: skip


@query("raw_integrity", _RAW_SQL)
def raw_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("u"), F.col("event_id").cast("long").alias("e"), (F.row_number().over(w) - 1).cast("long").alias("n"))
    raw = rows.selectExpr("u", "n", *[f"{e} AS {n}" for n, e in _RAW.items()])
    raw = raw.withColumn("payload_sha256", F.sha2(F.when((F.col("u") % 19 == 0) & (F.col("n") == 0), "x").otherwise(F.col("payload")), 256))
    m = raw.select("trace").distinct().withColumns({"host": F.lit("codex"), "interface_version": F.lit("codex-exec-jsonl/1"), "adapter_version": F.lit("1")})
    return P.raw_integrity(raw, m).select("trace", _joined("reasons").alias("reasons"))


_OVERRIDE = {
    "trace": "ck", "mode": "CASE WHEN ok % 2 = 0 THEN 'training_noncompetitive' ELSE 'redistribution' END", "at": "ok", "status": "CASE WHEN ok % 3 = 0 THEN 'deny' ELSE 'allow' END", "reviewer": "CASE WHEN ok % 5 <> 0 THEN 'r' ELSE '' END",
    "evidence_ref": "CASE WHEN ok % 7 <> 0 THEN 'letter:sha256:' || repeat('e', 64) ELSE 'letter' END", "reason": "'because'", "expires_at": "ok % 40 - 5", "owner": "CASE WHEN ok % 11 <> 0 THEN 'lab' END", "product": "'model'", "competes": "CASE ok % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'unknown' END",
}


@query("manual_overrides", f"""WITH t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _OVERRIDE.items())} FROM (SELECT CAST(o_custkey AS BIGINT) AS ck, CAST(o_orderkey AS BIGINT) AS ok FROM orders)),
  f AS (SELECT *, row_number() OVER (PARTITION BY trace, mode ORDER BY "at" DESC) AS r, count(*) OVER (PARTITION BY trace, mode) AS n FROM t WHERE reviewer <> '' AND {_REF.format("evidence_ref")} AND expires_at > 0 AND (mode = 'redistribution' OR (owner IS NOT NULL AND competes IN ('yes', 'no')))),
  d AS (SELECT CAST(c_custkey AS BIGINT) AS trace, unnest(['training_noncompetitive', 'redistribution']) AS mode FROM customer)
  SELECT d.trace, d.mode, coalesce(f.status, 'unknown') AS status, f.owner AS target_owner, f.product AS target_product, coalesce(f.competes, 'unknown') AS competitive, 1 + coalesce(f.n, 0) AS revision, CASE WHEN f.trace IS NULL THEN 'approved' ELSE 'pending' END AS approval, 'MANUAL_OVERRIDE_' || upper(f.status) AS code
  FROM d LEFT JOIN f ON f.trace = d.trace AND f.mode = d.mode AND f.r = 1""")  # fmt: skip
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("ck"), F.col("o_orderkey").cast("long").alias("ok"))
    none = F.lit(None).cast("string")
    modes = F.explode(F.array(F.lit("training_noncompetitive"), F.lit("redistribution"))).alias("mode")
    decisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("trace"), modes).withColumns({"status": F.lit("unknown"), "target_owner": none, "target_product": none, "competitive": F.lit("unknown"), "revision": F.lit(1).cast("long"), "approval": F.lit("approved")})
    return P.apply_overrides(decisions, o.selectExpr(*[f"{e} AS {n}" for n, e in _OVERRIDE.items()]), _NOW)
