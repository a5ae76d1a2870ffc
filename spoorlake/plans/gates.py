"""Policy gates over trace manifests: registry ceiling, terms, consent, rights; all reasons as sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

#: (id, provider, account types, automatic capture, non-competitive training, competitive distillation): parameters.
REGISTRY = (
    ("alpha-consumer", "p0", ("consumer",), "deny", "unknown", "deny"),
    ("alpha-services", "p0", ("api", "business"), "allow", "unknown", "deny"),
    ("beta-guidance", "p1", ("consumer", "api", "business"), "unknown", "unknown", "deny"),
    ("gamma-terms", "p2", ("api", "business"), "allow", "allow", "deny"),
    ("gamma-addendum", "p2", ("business",), "allow", "deny", "deny"),
    ("self-hosted", "p3", ("consumer", "api", "business"), "allow", "allow", "allow"),
)
RANK = {"deny": 0, "unknown": 1, "allow": 2}
MODES = ("automatic_capture", "training_noncompetitive", "training_competitive")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic trace manifests from customers and their orders' span of dates."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("trace"))
    k = F.col("trace")
    return c.select(
        "trace", F.concat(F.lit("p"), (k % 5).cast("string")).alias("provider"), F.element_at(F.array(F.lit("consumer"), F.lit("api"), F.lit("business"), F.lit("unknown")), (k % 4 + 1).cast("int")).alias("account_type"),
        F.when(k % 6 == 0, "deny").when(k % 6 == 1, "unknown").otherwise("allow").alias("decision"), (k % 7 != 0).alias("consent_active"), (k % 11 == 0).alias("withdrawn"),
        (k % 400).alias("terms_age_days"), (k % 9 != 0).alias("has_model"), F.when(k % 13 == 0, "unknown").when(k % 13 < 5, "yes").otherwise("no").alias("competitive"), (k % 17 == 0).alias("permission"),
    )


_MANIFESTS = """m AS (SELECT k AS trace, 'p' || (k % 5) AS provider, ['consumer', 'api', 'business', 'unknown'][k % 4 + 1] AS account_type, CASE k % 6 WHEN 0 THEN 'deny' WHEN 1 THEN 'unknown' ELSE 'allow' END AS decision,
  k % 7 <> 0 AS consent_active, k % 11 = 0 AS withdrawn, k % 400 AS terms_age_days, k % 9 <> 0 AS has_model, CASE WHEN k % 13 = 0 THEN 'unknown' WHEN k % 13 < 5 THEN 'yes' ELSE 'no' END AS competitive, k % 17 = 0 AS permission FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer))"""
_ROWS = ", ".join(f"('{i}', '{p}', '{t}', '{m}', {RANK[d]})" for i, p, types, *defaults in REGISTRY for t in types for m, d in zip(MODES, defaults))
_CEILING = f"""WITH {_MANIFESTS}, reg(id, provider, account_type, mode, rank) AS (VALUES {_ROWS}),
  g AS (SELECT m.*, u.mode, CASE decision WHEN 'deny' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS own FROM m, (SELECT unnest(['automatic_capture', 'training_noncompetitive', 'training_competitive']) AS mode) u),
  l AS (SELECT g.trace, g.mode, g.own, g.permission, min(reg.rank) AS lowest, string_agg(DISTINCT reg.id, ',' ORDER BY reg.id) FILTER (reg.rank = 0) AS denying FROM g LEFT JOIN reg ON reg.provider = g.provider AND reg.account_type = g.account_type AND reg.mode = g.mode GROUP BY ALL)"""


def registry_rows(spark: SparkSession) -> DataFrame:
    rows = [(i, p, t, m, RANK[d]) for i, p, types, *defaults in REGISTRY for t in types for m, d in zip(MODES, defaults)]
    return spark.createDataFrame(rows, "id string, provider string, account_type string, mode string, rank int")


def ceiling(traces: DataFrame, registry: DataFrame) -> DataFrame:
    """Each decision lowered to the most restrictive registry row that fits its provider and account type, unless a
    scoped permission allows it. The registry is a constant of the library, so it is broadcast."""
    own = F.when(F.col("decision") == "deny", 0).when(F.col("decision") == "unknown", 1).otherwise(2)
    each = traces.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES]))).withColumn("own", own)
    found = each.join(F.broadcast(registry), ["provider", "account_type", "mode"], "left")
    denying = F.array_join(F.array_sort(F.collect_set(F.when(F.col("rank") == 0, F.col("id")))), ",")
    found = found.groupBy("trace", "mode", "own", "permission").agg(F.min("rank").alias("lowest"), denying.alias("denying"))
    final = F.when((F.col("own") == 2) & F.col("permission"), F.col("own")).otherwise(F.least("own", F.coalesce("lowest", "own")))
    return found.withColumn("status", F.element_at(F.array(F.lit("deny"), F.lit("unknown"), F.lit("allow")), final + 1))


@query("registry_ceiling", _CEILING + """ SELECT trace, mode, coalesce(denying, '') AS denying, ['deny', 'unknown', 'allow'][CASE WHEN own = 2 AND permission THEN own ELSE least(own, coalesce(lowest, own)) END + 1] AS status FROM l""")
def registry_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ceiling(manifests(spark, sf_dir), registry_rows(spark)).select("trace", "mode", "denying", "status")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull()))


def gate_reasons() -> Column:
    """Reasons that block training without competition."""
    return reasons(
        (~F.col("consent_active"), "CONSENT_INACTIVE"), (F.col("withdrawn"), "CONSENT_WITHDRAWN"), (F.col("account_type") == "unknown", "ACCOUNT_TYPE_UNKNOWN"),
        (F.col("terms_age_days") > 180, "TERMS_MISSING_OR_STALE"), (~F.col("has_model"), "TEACHER_MODEL_UNKNOWN"), (F.col("competitive") == "unknown", "COMPETITIVENESS_UNKNOWN"),
        (F.col("competitive") != "no", "NONCOMPETITIVE_DECISION_REQUIRED"), (F.col("decision") == "deny", "DECISION_DENY"), (F.col("decision") == "unknown", "DECISION_UNKNOWN"),
    )


@query("training_gate", f"""WITH {_MANIFESTS}, r AS (SELECT trace, list_sort(list_filter([CASE WHEN NOT consent_active THEN 'CONSENT_INACTIVE' END, CASE WHEN withdrawn THEN 'CONSENT_WITHDRAWN' END, CASE WHEN account_type = 'unknown' THEN 'ACCOUNT_TYPE_UNKNOWN' END,
  CASE WHEN terms_age_days > 180 THEN 'TERMS_MISSING_OR_STALE' END, CASE WHEN NOT has_model THEN 'TEACHER_MODEL_UNKNOWN' END, CASE WHEN competitive = 'unknown' THEN 'COMPETITIVENESS_UNKNOWN' END, CASE WHEN competitive <> 'no' THEN 'NONCOMPETITIVE_DECISION_REQUIRED' END,
  CASE WHEN decision = 'deny' THEN 'DECISION_DENY' END, CASE WHEN decision = 'unknown' THEN 'DECISION_UNKNOWN' END], lambda x: x IS NOT NULL)) AS codes FROM m)
  SELECT trace, len(codes) = 0 AS allowed, array_to_string(codes, ',') AS reason_codes FROM r""")  # fmt: skip
def training_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests(spark, sf_dir).withColumn("codes", gate_reasons())
    return rows.select("trace", (F.size("codes") == 0).alias("allowed"), F.array_join("codes", ",").alias("reason_codes"))


@query("gate_status_counts", f"WITH {_MANIFESTS} SELECT decision AS status, competitive, count(*) AS n FROM m GROUP BY ALL")
def gate_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests(spark, sf_dir).groupBy(F.col("decision").alias("status"), "competitive").agg(F.count("*").alias("n"))
