"""Policy predicates over manifest rows: permissions, capture, default eligibility, rights, approvals, terms, raw integrity.

All are column expressions, or aggregates on the trace; a decision is a struct ``status, code``. Times are any ordered
type; ``now`` is given. Reason codes are the interface's vocabulary and come as sorted arrays without repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINING = ("training_noncompetitive", "training_competitive_distillation")
MACHINE_ACCOUNTS = ("api", "business", "enterprise", "managed_workspace")
OPEN_LICENSES = ("MIT", "APACHE-2.0", "CC0-1.0")
LICENSES = (*OPEN_LICENSES, "BSD-2-CLAUSE", "BSD-3-CLAUSE", "CC-BY-4.0", "GPL-3.0-ONLY", "ISC", "MPL-2.0")
#: What a consent may be called for each mode.
PURPOSES = {
    "archive": ("archive",), "automatic_capture": ("capture", "authorized-capture", "automatic_capture"), "training_noncompetitive": ("training_noncompetitive", "sft"),
    "training_competitive_distillation": ("training_competitive_distillation", "distillation"), "redistribution": ("redistribution", "release"),
}
_DIGEST = "sha256:[a-f0-9]{64}"


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, sorted; a null condition doesn't hold."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull()))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def artifact_reference(ref: Column) -> Column:
    """``kind:sha256:digest``, with a kind of at most 64 characters."""
    kind = F.regexp_extract(ref, rf"^([a-z][a-z0-9]*(?:[._-][a-z0-9]+)*):{_DIGEST}$", 1)
    return F.coalesce((kind != "") & (F.length(kind) <= 64), F.lit(False))


def canonical_origin(origin: Column) -> Column:
    """Scheme and host in lower case, without default port or path; null if there is no such origin."""
    low = F.lower(F.trim(origin))
    found = F.regexp_extract(low, r"^(https?://[^/?#@:]+(?::[0-9]+)?)(?:[/?#].*)?$", 1)
    found = F.when(F.startswith(low, F.lit("https:")), F.regexp_replace(found, ":443$", "")).otherwise(F.regexp_replace(found, ":80$", ""))
    return F.when(found != "", found)


def authority_url(url: Column) -> Column:
    """Without trailing slashes, in lower case."""
    return F.lower(F.regexp_replace(url, "/+$", ""))


def license_known(license: Column) -> Column:
    return F.upper(F.trim(F.coalesce(license, F.lit("")))).isin(*LICENSES)


def rights_clear(license: Column, basis: Column, third_party: Column, holder: Column) -> Column:
    """Whether training is clear of others' rights: all known, and foreign content licensed, consented or public, with
    a holder."""
    known = license_known(license) & (F.coalesce(basis, F.lit("unknown")) != "unknown") & (F.coalesce(third_party, F.lit("unknown")) != "unknown")
    return known & ((third_party != "present") | (basis.isin("licensed", "consented", "public_domain") & ~_blank(holder)))


def permission_reasons(purpose: str, now: Column | int) -> Column:
    """Why the scoped permission (columns ``p_*``; none if ``p_ref`` is null) doesn't cover ``purpose``; empty: it does."""
    c = F.col
    source, listed = canonical_origin(c("origin")), F.transform("p_origins", canonical_origin)
    foreign = (c("origin").isNotNull() & source.isNull()) | (source.isNull() & (F.size("p_origins") > 0)) | (source.isNotNull() & ~F.array_contains(listed, source))
    other = ~(c("p_owner").eqNullSafe(c("target_owner")) & c("p_product").eqNullSafe(c("target_product")))
    named = c("p_owner").isNotNull() | c("p_product").isNotNull()
    if purpose in TRAINING:
        target = _blank(c("target_owner")) | _blank(c("target_product")) | other
    else:
        target = named if purpose == "automatic_capture" else named & other
    known = lambda a, b: (F.col(a) != "unknown") & (F.col(b) != "unknown")
    found = codes(
        (~artifact_reference(c("p_ref")), "SCOPED_PERMISSION_EVIDENCE_REFERENCE_INVALID"), (_blank(c("p_reviewer")), "SCOPED_PERMISSION_REVIEWER_MISSING"),
        (c("written_ref") != c("p_ref"), "SCOPED_PERMISSION_REFERENCE_MISMATCH"), (~known("provider", "p_provider"), "SCOPED_PERMISSION_PROVIDER_UNKNOWN"),
        (known("provider", "p_provider") & (c("provider") != c("p_provider")), "SCOPED_PERMISSION_PROVIDER_MISMATCH"), (~known("account_type", "p_account"), "SCOPED_PERMISSION_ACCOUNT_UNKNOWN"),
        (known("account_type", "p_account") & (c("account_type") != c("p_account")), "SCOPED_PERMISSION_ACCOUNT_MISMATCH"), (~F.array_contains("p_methods", c("capture_method")), "SCOPED_PERMISSION_CAPTURE_METHOD_MISMATCH"),
        (foreign, "SCOPED_PERMISSION_ORIGIN_MISMATCH"), (~F.array_contains("p_purposes", F.lit(purpose)), "SCOPED_PERMISSION_PURPOSE_MISMATCH"), (F.coalesce(c("p_from") > now, F.lit(True)), "SCOPED_PERMISSION_NOT_YET_EFFECTIVE"),
        (F.coalesce((c("p_until") <= now) | (c("p_until") <= c("p_from")), F.lit(True)), "SCOPED_PERMISSION_EXPIRED"), (target, "SCOPED_PERMISSION_TARGET_MISMATCH"),
    )
    return F.when(c("p_ref").isNull(), F.array(F.lit("SCOPED_PERMISSION_REQUIRED"))).otherwise(found)


def permitted(purpose: str, now: Column | int) -> Column:
    return F.size(permission_reasons(purpose, now)) == 0


def _natively_observed() -> Column:
    c = F.col
    native = (c("host").isin("codex", "claude_code") & c("capture_method").isin("official_stream", "official_hook")) | ((c("host") == "deepseek_harness") & (c("capture_method") == "instrumented_harness"))
    return (c("authenticity") == "locally_observed") & native


def _harness() -> Column:
    c = F.col
    return (c("host") == "deepseek_harness") & (c("surface") == "harness") & (c("capture_method") == "instrumented_harness") & c("model_id").isNotNull() & _natively_observed()


def trusted_teacher() -> Column:
    """The one path whose requests can be matched to durable events."""
    ref = F.coalesce(F.col("authenticity_ref"), F.lit(""))
    return _harness() & (F.col("provider") == "deepseek") & ref.rlike(f"^native-request-header:{_DIGEST}$")


def trusted_self_hosted() -> Column:
    digest = F.col("weights_digest")
    whole = _harness() & (F.col("provider") == "self_hosted") & digest.rlike(f"^{_DIGEST}$") & (F.col("authenticity_ref") == F.concat(F.lit("local-model-artifact:"), digest))
    return F.coalesce(whole, F.lit(False))


def manual() -> Column:
    return F.col("capture_method").isin("official_export", "manual_copy")


def _first(*cases: tuple[Column, str, str], otherwise: tuple[str, str]) -> Column:
    """The decision of the first condition that holds."""
    made = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
    out = None
    for condition, status, code in cases:
        out = F.when(condition, made(status, code)) if out is None else out.when(condition, made(status, code))
    return out.otherwise(made(*otherwise))


def automatic_capture(now: Column | int) -> Column:
    provider, account = F.col("provider"), F.col("account_type")
    return _first(
        (manual(), "deny", "MANUAL_PATH_NOT_AUTOMATIC"), (F.col("capture_method") == "authorized_dom", "unknown", "SITE_AUTHORIZATION_REQUIRED"),
        (permitted("automatic_capture", now), "allow", "SCOPED_AUTOMATIC_CAPTURE_PERMISSION"), (trusted_self_hosted() & (account == "self_hosted"), "allow", "SELF_HOSTED_AUTHORITY"),
        (F.col("surface") == "web", "deny", "COMMERCIAL_WEB_AUTOMATION_BLOCKED"), ((provider == "openai") & (account == "consumer"), "deny", "OPENAI_CONSUMER_AUTOMATED_EXTRACTION"),
        ((provider == "anthropic") & (account == "consumer"), "deny", "ANTHROPIC_CONSUMER_AUTOMATED_ACCESS"), (account.isin(*MACHINE_ACCOUNTS), "allow", "OFFICIAL_MACHINE_INTERFACE"),
        otherwise=("unknown", "ACCOUNT_OR_CONTRACT_UNKNOWN"),
    )


def _training(competitive: bool, now: Column | int) -> Column:
    """Before the registry's ceiling."""
    provider = F.col("provider")
    chain = (provider != "self_hosted") | ((F.size("license_chain") > 0) & F.forall("license_chain", license_known))
    rights = rights_clear(F.col("license"), F.col("rights_basis"), F.col("third_party"), F.col("rights_holder")) & chain
    captured = (automatic_capture(now)["status"] == "allow") | manual()
    mine = lambda a, b: a if competitive else b
    return _first(
        (~F.col("consent_active") | ~rights, "unknown", "CONSENT_OR_RIGHTS_INCOMPLETE"), (~_blank(F.col("written_ref")), "unknown", "SCOPED_TRAINING_OVERRIDE_REQUIRED"),
        (trusted_teacher() & captured, "allow", mine("DEEPSEEK_DISTILLATION_ALLOWED", "DEEPSEEK_OUTPUT_TRAINING_ALLOWED")),
        (trusted_self_hosted() & (F.col("account_type") == "self_hosted"), "unknown", "SELF_HOSTED_RUNTIME_BINDING_REQUIRED"),
        (provider == "openai", *mine(("deny", "OPENAI_COMPETITIVE_MODEL_TRAINING"), ("unknown", "OPENAI_PERMITTED_EXCEPTION_NOT_ESTABLISHED"))),
        (provider == "anthropic", *mine(("deny", "ANTHROPIC_COMPETITIVE_MODEL_TRAINING"), ("unknown", "ANTHROPIC_NONCOMPETITIVE_SCOPE_NOT_ESTABLISHED"))),
        otherwise=("unknown", "TRAINING_PERMISSION_UNKNOWN"),
    )


def default_eligibility(now: Column | int) -> dict[str, Column]:
    """A decision for each mode, before the registry's ceiling (see ``plans.gates.ceiling``); scoped permissions stand
    above it."""
    scoped = lambda mode, code, decision: F.when(F.col("consent_active") & trusted_teacher() & permitted(mode, now), F.struct(F.lit("allow").alias("status"), F.lit(code).alias("code"))).otherwise(decision)
    open_license = F.upper(F.trim(F.coalesce("license", F.lit("")))).isin(*OPEN_LICENSES)
    return {
        "archive": _first((F.col("consent_active"), "allow", "EXPLICIT_LOCAL_ARCHIVE_CONSENT"), otherwise=("deny", "CONSENT_INACTIVE")),
        "automatic_capture": automatic_capture(now),
        "training_noncompetitive": scoped("training_noncompetitive", "SCOPED_NONCOMPETITIVE_TRAINING_PERMISSION", _training(False, now)),
        "training_competitive_distillation": scoped("training_competitive_distillation", "SCOPED_COMPETITIVE_TRAINING_PERMISSION", _training(True, now)),
        "redistribution": _first(
            (F.col("consent_active") & permitted("redistribution", now), "allow", "SCOPED_REDISTRIBUTION_PERMISSION"), (open_license, "allow", "REDISTRIBUTABLE_SOURCE_LICENSE"), otherwise=("unknown", "REDISTRIBUTION_NOT_ESTABLISHED")
        ),
    }


def consented(purposes: Column, mode: str) -> Column:
    """Whether a consent's purposes name the mode, by any of its names."""
    return F.exists(purposes, lambda p: F.lower(F.trim(p)).isin(*PURPOSES[mode]))


def terms_checks(terms: DataFrame, registry: DataFrame, accounts: DataFrame, now: Column | int) -> DataFrame:
    """``trace, current, matched, pinned, conflicting`` for ``accounts`` (trace, provider, account_type), from ``terms``
    (trace, name, url, effective_at, retrieved_at, review_after, snapshot) and ``registry`` (provider, account_type, url,
    accepted: digests). The registry is a constant of the library, so it is broadcast."""
    t = terms.withColumn("url", authority_url(F.col("url")))
    fresh = F.coalesce((F.col("effective_at") <= now) & (F.col("retrieved_at") <= now) & (F.col("review_after") > now), F.lit(False))
    of = t.groupBy("trace").agg(F.bool_and(fresh).alias("fresh"), F.collect_set("url").alias("urls"))
    versions = t.groupBy("trace", "name", "url", "effective_at").agg(F.count_distinct("snapshot").alias("n"))
    conflict = versions.groupBy("trace").agg((F.max("n") > 1).alias("conflicting"))
    rules = F.broadcast(registry.select("provider", "account_type", authority_url(F.col("url")).alias("url"), F.transform("accepted", F.lower).alias("accepted")))
    asked = accounts.join(rules, ["provider", "account_type"]).select("trace", "url", "accepted")
    met = asked.join(t.select("trace", "url", F.lower("snapshot").alias("snapshot")), ["trace", "url"], "left")
    each = met.groupBy("trace", "url").agg(F.bool_or(F.col("snapshot").isNotNull()).alias("seen"), F.coalesce(F.bool_or(F.array_contains("accepted", F.col("snapshot"))), F.lit(False)).alias("held"))
    rule = each.groupBy("trace").agg(F.bool_and("seen").alias("seen"), F.bool_and("held").alias("held"))
    own, no = F.col("provider") == "self_hosted", F.lit(False)
    return accounts.join(of, "trace", "left").join(conflict, "trace", "left").join(rule, "trace", "left").select(
        "trace", (own | F.coalesce("fresh", no)).alias("current"), (own | F.coalesce("seen", no)).alias("matched"), (own | F.coalesce("held", no)).alias("pinned"), F.coalesce("conflicting", no).alias("conflicting")
    )


def attestation_reasons(mode: str, now: Column | int) -> Column:
    """Why an event's rights attestation (columns ``a_*``; none if ``a_event`` is null) doesn't hold for ``mode``."""
    c = F.col
    scope = F.exists("a_scopes", lambda s: (s["mode"] == mode) & s["owner"].eqNullSafe(c("target_owner")) & s["product"].eqNullSafe(c("target_product")))
    found = codes(
        (~c("a_event").eqNullSafe(c("event_sha256")), "RIGHTS_ATTESTATION_EVENT_CHANGED"), (~c("a_source").eqNullSafe(c("source_sha256")), "RIGHTS_ATTESTATION_SOURCE_CHANGED"),
        (c("a_at") > now, "RIGHTS_ATTESTATION_NOT_YET_VALID"), (c("a_until") <= now, "RIGHTS_ATTESTATION_EXPIRED"), (~F.coalesce(scope, F.lit(False)), "RIGHTS_ATTESTATION_SCOPE_MISMATCH"),
        (F.exists("overrides", lambda x: x.isNotNull() & (x != c("a_rights"))), "RIGHTS_ATTESTATION_CONTENT_MISMATCH"),
    )
    return F.when(c("a_event").isNull(), F.array(F.lit("RIGHTS_ATTESTATION_REQUIRED"))).otherwise(found)


def approval_reasons() -> Column:
    """Why an approval's scope (columns ``s_*``; none if ``s_bundle`` is null) isn't that of the row now: approval,
    bundle digest, reviewer, time, notes, and the decision of the mode (``s_decision`` null: mode not approved)."""
    c = F.col
    known = ~_blank(c("reviewer")) & c("reviewed_at").isNotNull() & ~_blank(c("notes"))
    scoped, has = c("s_bundle").isNotNull(), c("s_decision").isNotNull()
    other = ~(c("s_owner").eqNullSafe(c("target_owner")) & c("s_product").eqNullSafe(c("target_product")))
    return codes(
        (c("human_approval") != "approved", "HUMAN_APPROVAL_REQUIRED"), (~scoped, "APPROVAL_SCOPE_REQUIRED"), (c("s_bundle") != c("bundle_sha256"), "APPROVAL_CONTENT_CHANGED"),
        (scoped & ~known, "APPROVAL_PROVENANCE_REQUIRED"), (scoped & known & (c("s_reviewer") != c("reviewer")), "APPROVAL_REVIEWER_CHANGED"), (scoped & known & (c("s_time") != c("reviewed_at")), "APPROVAL_TIME_CHANGED"),
        (scoped & known & (c("s_notes") != F.sha2("notes", 256)), "APPROVAL_NOTES_CHANGED"), (scoped & ~has, "APPROVAL_MODE_NOT_APPROVED"),
        (scoped & has & (c("s_decision") != c("decision_id")), "APPROVAL_DECISION_CHANGED"), (scoped & has & other, "APPROVAL_TARGET_CHANGED"),
    )


#: Interface versions that each adapter's raw rows may have.
INTERFACES = {
    "codex": ("codex-exec-jsonl/1", "codex-hook/1", "codex-app-server-v2-jsonrpc/1"), "claude_code": ("claude-stream-json/1", "claude-hook/1", "claude-transcript-opaque/1"),
    "gemini_cli": ("gemini-cli-hook/1",), "browser": ("authorized-dom/0.1",),
}


def raw_integrity(raw: DataFrame, manifests: DataFrame, interfaces: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``trace, reasons`` for traces with raw rows (trace, ordinal, sequence, adapter, interface_version, adapter_version,
    payload, payload_sha256), against ``manifests`` (trace, host, interface_version, adapter_version). The digest of all
    rows in order is taken over the rows' digests."""
    pinned = F.lit(False)
    for adapter, versions in (interfaces or INTERFACES).items():
        pinned = pinned | ((F.col("adapter") == adapter) & F.col("interface_version").isin(*versions))
    stored = Window.partitionBy("trace").orderBy("ordinal")
    rows = raw.join(manifests.select("trace", "host", F.col("interface_version").alias("m_interface"), F.col("adapter_version").alias("m_adapter")), "trace")
    rows = rows.withColumn("before", F.lag("sequence").over(stored))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "+")
    of = rows.groupBy("trace").agg(
        F.bool_or(F.col("sequence") <= F.col("before")).alias("falls"), F.bool_or(F.col("adapter") != F.col("host")).alias("adapter"), F.bool_or(~pinned).alias("interface"),
        F.bool_or(F.sha2("payload", 256) != F.col("payload_sha256")).alias("digest"), F.count("*").alias("n"), F.count_distinct("sequence").alias("distinct"), F.min("sequence").alias("low"), F.max("sequence").alias("high"),
        (joined("interface_version") != F.first("m_interface")).alias("versions"), (joined("adapter_version") != F.first("m_adapter")).alias("adapters"),
    )
    return of.select("trace", codes(
        (F.col("falls"), "RAW_SEQUENCE_NON_MONOTONIC"), (F.col("adapter"), "RAW_ADAPTER_MISMATCH"), (F.col("interface"), "RAW_INTERFACE_UNSUPPORTED"), (F.col("digest"), "RAW_PAYLOAD_HASH_MISMATCH"),
        ((F.col("low") != 0) | (F.col("high") != F.col("distinct") - 1), "RAW_SEQUENCE_GAP"), (F.col("n") > F.col("distinct"), "RAW_SEQUENCE_DUPLICATE"),
        (F.col("versions"), "RAW_INTERFACE_MANIFEST_MISMATCH"), (F.col("adapters"), "RAW_ADAPTER_VERSION_MANIFEST_MISMATCH"),
    ).alias("reasons"))


def apply_overrides(decisions: DataFrame, overrides: DataFrame, now: Column | int) -> DataFrame:
    """``decisions`` (trace, mode, status, target_owner, target_product, competitive, revision, approval) with the latest
    admissible of ``overrides`` (trace, mode, at, status, reviewer, evidence_ref, reason, expires_at, owner, product,
    competes): reviewer, reason and evidence given, not expired, and for training an explicit target and competition.
    An override raises the revision and takes the approval back."""
    training = F.col("mode").isin(*TRAINING)
    named = ~_blank(F.col("owner")) & ~_blank(F.col("product")) & F.col("competes").isin("yes", "no")
    fine = ~_blank(F.col("reviewer")) & ~_blank(F.col("reason")) & artifact_reference(F.col("evidence_ref")) & (F.col("expires_at") > now) & (~training | named)
    last = overrides.where(fine).groupBy("trace", "mode").agg(F.max_by(F.struct("status", "owner", "product", "competes"), "at").alias("o"), F.count("*").alias("n"))
    out, new = decisions.join(last, ["trace", "mode"], "left"), F.col("o").isNotNull()
    return out.select(
        "trace", "mode", F.coalesce("o.status", "status").alias("status"), F.coalesce("o.owner", "target_owner").alias("target_owner"), F.coalesce("o.product", "target_product").alias("target_product"),
        F.coalesce("o.competes", "competitive").alias("competitive"), (F.col("revision") + F.coalesce("n", F.lit(0))).alias("revision"), F.when(new, "pending").otherwise(F.col("approval")).alias("approval"),
        F.when(new, F.concat(F.lit("MANUAL_OVERRIDE_"), F.upper("o.status"))).alias("code"),
    )
