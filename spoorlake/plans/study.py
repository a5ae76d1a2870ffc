"""Study and evidence queries: tasks, answers and metrics, suites, rendered chats, tokens, opaque fields, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..functions.hashing import split_bucket, split_of
from ..functions.udfs import redact_udf
from .canonical import EV, canonical
from .registry import query, table
from .splits import _BUCKET, _SPLIT, RATIOS, SEED

_TASK = {"a": "id % 97 + 1", "b": "id % 41 + 2", "c": "id % 13", "arm": "CASE id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'answer_only' ELSE 'complete' END"}


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded arithmetic tasks, one an order, with the texts that a model gave: good, enveloped, or broken in known ways."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id")).selectExpr("id", *[f"{e} AS {n}" for n, e in _TASK.items()])
    expression = F.format_string("%d * (%d + %d)", "a", "b", "c")
    call = F.format_string('{"name": "calculator", "arguments": {"expression": "%s"}}', expression)
    call = F.when(F.col("id") % 7 == 0, F.format_string('{"protocol": "p/1", "tool_calls": [{"function": %s}]}', call)).when(F.col("id") % 11 == 0, "not json").when(F.col("id") % 13 == 0, '{"name": "other", "arguments": {}}').otherwise(call)
    right = F.col("a") * (F.col("b") + F.col("c"))
    final = F.when(F.col("id") % 5 == 0, F.format_string('{"answer": %d}', right + 1)).when(F.col("id") % 17 == 0, '{"answer": "x"}').when(F.col("id") % 4 == 0, F.format_string('{"protocol": "p/1", "content": "{\\"answer\\": %d}"}', right)).otherwise(F.format_string('{"answer": %d}', right))
    return o.select("id", "arm", expression.alias("expression"), right.alias("right"), call.alias("call"), final.alias("final"))


_T = "t AS (SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in _TASK.items()) + " FROM (SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders))"
_J = f"WITH {_T}, j AS (SELECT *, id % 7 = 0 OR (id % 11 <> 0 AND id % 13 <> 0) AS called, id % 5 = 0 OR id % 17 <> 0 AS valid, id % 5 <> 0 AND id % 17 <> 0 AS correct FROM t)"


@query("study_answers", f"""{_J} SELECT id, CASE WHEN called THEN a * (b + c) END AS value, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN 'invalid_json' WHEN id % 13 = 0 THEN 'wrong_tool_or_arguments_shape' END AS call_error, CASE WHEN valid THEN a * (b + c) + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END END AS answer, CASE WHEN NOT valid THEN 'answer_not_integer' END AS final_error FROM j""")
def study_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls parsed and calculated, answers parsed."""
    return tasks(spark, sf_dir).select("id", E.judged_udf()("call", "final").alias("j")).select("id", "j.value", "j.call_error", "j.answer", "j.final_error")


@query("study_metrics", f"""{_J} SELECT arm, count(*) AS examples, count(*) FILTER (called) AS tool_json_valid, count(*) FILTER (called) AS tool_outcome_correct, count(*) FILTER (valid) AS final_json_valid, count(*) FILTER (correct) AS final_accuracy, count(*) FILTER (called AND correct) AS end_to_end_success,
  count(*) FILTER (called AND correct) / count(*) AS end_to_end_rate FROM j GROUP BY 1""")  # fmt: skip
def study_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates by arm."""
    j = tasks(spark, sf_dir).withColumn("j", E.judged_udf()("call", "final"))
    ok = {"tool_json_valid": F.col("j.call_error").isNull(), "tool_outcome_correct": F.col("j.value") == F.col("right"), "final_json_valid": F.col("j.final_error").isNull(), "final_accuracy": F.col("j.answer") == F.col("right")}
    ok = {k: F.coalesce(c, F.lit(False)) for k, c in ok.items()}
    both = ok["tool_outcome_correct"] & ok["final_accuracy"]
    return j.groupBy("arm").agg(F.count("*").alias("examples"), *[F.count_if(c).alias(k) for k, c in ok.items()], F.count_if(both).alias("end_to_end_success"), F.avg(both.cast("double")).alias("end_to_end_rate"))


@query("suite_validation", f"""WITH {_T}, e AS (SELECT *, a || ' * (' || b || ' + ' || c || ')' AS x, id % 10 < 8 AS train FROM t), b AS (SELECT x FROM e GROUP BY 1 HAVING bool_or(train) AND bool_or(NOT train))
  SELECT arm, count(*) AS tasks, count(*) FILTER (NOT train AND x IN (SELECT x FROM b)) AS leaked, count(DISTINCT x) AS distinct_tasks FROM e GROUP BY 1""")  # fmt: skip
def suite_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation tasks that training has too, by arm; tasks are compared whatever the arm."""
    t = tasks(spark, sf_dir).withColumn("train", F.col("id") % 10 < 8)
    both = t.groupBy("expression").agg((F.bool_or("train") & F.bool_or(~F.col("train"))).alias("both"))
    per = t.join(both, "expression").groupBy("arm", "expression", "both").agg(F.count("*").alias("n"), F.count_if(~F.col("train")).alias("held"))
    return per.groupBy("arm").agg(F.sum("n").alias("tasks"), F.sum(F.when(F.col("both"), F.col("held")).otherwise(0)).alias("leaked"), F.count("*").alias("distinct_tasks"))


@query("chat_rendering", """WITH m AS (SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS x, role FROM conversations) SELECT conv_id, md5(string_agg(x, '' ORDER BY turn)) AS digest, sum(length(x))::BIGINT AS chars, coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS supervised_chars FROM m GROUP BY 1""")
def chat_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the chat mark-up of supervised samples, and how much of them the assistant wrote."""
    x = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", x.alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "x")))
    return rows.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(ordered, lambda m: m["x"]), "")).alias("digest"), F.sum(F.length("x")).cast("long").alias("chars"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.length("x"))), F.lit(0)).cast("long").alias("supervised_chars"))


@query("token_accounting", r"""WITH w AS (SELECT conv_id, role, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE text IS NOT NULL)
  SELECT role, count(*) AS samples, sum(n)::BIGINT AS tokens, sum(n) FILTER (last)::BIGINT AS target_tokens, max(n) AS longest FROM w GROUP BY 1""")  # fmt: skip
def token_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and tokens (here: words) by role, and those of last turns."""
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")).cast("long")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "role", n.alias("n"), (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))).alias("last"))
    return rows.groupBy("role").agg(F.count("*").alias("samples"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("last"), F.col("n"))).alias("target_tokens"), F.max("n").alias("longest"))


@query("split_tables", f"""WITH d AS (SELECT *, {_SPLIT} AS split FROM (SELECT *, {_BUCKET} AS bucket FROM documents)) SELECT split, count(*) AS examples, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id, count(*) FILTER (lang = 'en') AS english FROM d GROUP BY 1""")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each split's table holds, in one aggregation."""
    d = table(spark, sf_dir, "documents").withColumn("split", split_of(split_bucket(SEED, F.col("source")), RATIOS))
    return d.groupBy("split").agg(F.count("*").alias("examples"), F.count_distinct("source").alias("sources"), F.sum("n_chars").cast("long").alias("chars"), F.min("doc_id").alias("first_id"), F.count_if(F.col("lang") == "en").alias("english"))


@query("opaque_inventory", EV + """, x AS (SELECT CASE k % 6 WHEN 0 THEN 'anthropic_thinking_signature' WHEN 1 THEN 'anthropic_redacted_thinking' WHEN 2 THEN 'openai_encrypted_reasoning' WHEN 3 THEN 'google_thought_signature' END AS kind FROM ev) SELECT kind, count(*) AS fields FROM x WHERE kind IS NOT NULL GROUP BY 1""")
def opaque_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque reasoning fields of (here: made) payloads by kind; plaintext is never returned."""
    body = F.element_at(F.array(*[F.lit(x) for x in (
        '{"content": [{"type": "thinking", "signature": "s"}, {"type": "text", "signature": "no"}]}', '{"a": {"b": [{"type": "redacted_thinking", "data": "d"}]}}', '[{"type": "reasoning", "encryptedContent": "e", "encrypted_content": ""}]',
        '{"parts": [{"thoughtSignature": "g"}, {"thought_signature": 7}]}', '{"type": "thinking", "signature": ""}', "not json",
    )]), (F.col("k") % 6 + 1).cast("int"))
    found = canonical(spark, sf_dir).select(E.opaque_fields_udf()(body).alias("o")).select(F.explode("o.fields").alias("f"))
    return found.groupBy("f.kind").agg(F.count("*").alias("fields"))


@query("metadata_search", EV + """ SELECT trace_id, event_id, CASE k % 4 WHEN 0 THEN 'r' || k WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN 'deep' END AS repo, CASE k % 3 WHEN 0 THEN 'v' || k || '@1' WHEN 1 THEN 'pytest@8' END AS verifier FROM ev""")
def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value under a set of names at any depth, and a verifier's identity."""
    k = F.col("k")
    repo = F.when(k % 4 == 0, F.format_string('"Repo": "r%d"', k)).when(k % 4 == 1, F.format_string('"x": [{"repository_id": %d}]', k)).when(k % 4 == 2, '"a": {"b": {"repo": " "}, "c": {"REPO": " deep "}}').otherwise('"a": {"b": {"c": {"d": {"e": {"repo": "too deep"}}}}}')
    verifier = F.when(k % 3 == 0, F.format_string('"verifier": {"name": "v%d", "version": "1"}', k)).when(k % 3 == 1, '"grader": {"name": "half"}, "m": {"grader_name": "pytest", "Verifier_Version": 8}').otherwise('"verifier": "just a name"')
    text = F.concat(F.lit("{"), repo, F.lit(", "), verifier, F.lit("}"))
    return canonical(spark, sf_dir).select("trace_id", "event_id", E.first_text_udf("repo", "repository_id")(text).alias("repo"), E.verifier_identity_udf()(text).alias("verifier"))


@query("sanitized_parts", r"""WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(text, '(?i)\b[\w.+%-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}\b') AS mails FROM conversations)
  SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'quarantined' WHEN len(mails) + other > 0 THEN 'redacted' ELSE 'passed' END AS status FROM (SELECT *, """ + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for k, (_, ps) in T.DETECTORS.items() if k not in ("phone", "email") for p in ps) + r""" + len(list_filter(regexp_extract_all(text, '\+?[0-9](?:[ ().-]*[0-9]){7,}'), lambda x: NOT regexp_matches(x, '^\d{4}-\d{2}-\d{2}') AND length(regexp_replace(x, '[^0-9]', '', 'g')) <= 15)) AS other FROM c)""")  # fmt: skip
def sanitized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts made safe: without content quarantined, with findings replaced and marked, else passed."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", redact_udf()("text").alias("safe"))
    return rows.select("conv_id", "turn", F.when(F.col("text").isNull(), "quarantined").when(F.col("text") != F.col("safe"), "redacted").otherwise("passed").alias("status"))


@query("request_tools", EV + """, h AS (SELECT trace_id, coalesce(session_id, '') AS session, arg_max(k, sequence) AS k FROM sel WHERE event_type = 'model.inference' GROUP BY 1, 2)
  SELECT trace_id, session, count(*) FILTER (o <> 1) AS tools, CASE WHEN bool_or(o = 1) THEN 'TOOL_SCHEMA_INVALID_OR_UNAVAILABLE' ELSE '' END AS issues FROM (SELECT *, unnest(range(0, k % 4)) AS o FROM h) GROUP BY 1, 2""")  # fmt: skip
def request_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools of each session's last request header: schemas are JSON objects with a name of their own and parameters."""
    ev = canonical(spark, sf_dir).where("include AND event_type = 'model.inference'").withColumn("session", F.coalesce("session_id", F.lit("")))
    last = ev.groupBy("trace_id", "session").agg(F.max_by("k", "sequence").alias("k"))
    schemas = F.expr("""transform(filter(sequence(0L, 3L), o -> o < k % 4), o -> CASE WHEN o = 1 THEN '{"name": "t0", "inputSchema": 3}' ELSE concat('{"name": "t', o, '", "parameters": {"type": "object"}}') END)""")
    rows = last.select("trace_id", "session", F.posexplode(schemas).alias("at", "schema"))
    name = F.get_json_object("schema", "$.name")
    given = F.coalesce(*[F.get_json_object("schema", f"$.{n}") for n in ("inputSchema", "input_schema", "parameters")])
    fine = F.coalesce((name != "") & F.startswith(given, F.lit("{")), F.lit(False))
    first = F.row_number().over(Window.partitionBy("trace_id", "session", name, fine).orderBy("at")) == 1
    judged = rows.withColumn("good", fine & first)
    return judged.groupBy("trace_id", "session").agg(F.count_if("good").alias("tools"), F.when(F.bool_or(~F.col("good")), "TOOL_SCHEMA_INVALID_OR_UNAVAILABLE").otherwise("").alias("issues"))
