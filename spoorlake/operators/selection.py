"""Content parts of events: what is selected, cleared, readable and re-keyed; topology of spans; metadata predicates.

``content`` is an array of structs ``ordinal, type, value, blob_ref, sha256, status, sensitivity, keep`` and, for
reasoning, ``representation, claim, visibility, source_field``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEARED = ("passed", "redacted")
PROJECTIONS = {"tool.call": "tool_call", "tool.result": "tool_result"}


def kept(content: Column) -> Column:
    """Selected parts by ordinal."""
    return F.array_sort(F.filter(content, lambda p: p["keep"]))  # structs are ordered by their first field


def projection_excluded(event_type: Column, content: Column) -> Column:
    """Whether a tool event must go whole, as one of its own tool parts isn't selected."""
    own = F.when(event_type == "tool.call", "tool_call").when(event_type == "tool.result", "tool_result")
    return F.coalesce(F.exists(content, lambda p: (p["type"] == own) & ~p["keep"]), F.lit(False))


def ordinary_text(content: Column) -> Column:
    """The non-empty values of selected parts that are neither reasoning nor tool parts, a line each."""
    plain = F.filter(kept(content), lambda p: ~p["type"].isin("reasoning", "tool_call", "tool_result") & (F.length(p["value"]) > 0))
    return F.array_join(F.transform(plain, lambda p: p["value"]), "\n")


def strict_reasoning(content: Column) -> Column:
    """There is reasoning, and all of it was exposed by the provider as such, from a named field, with a value."""
    parts = F.filter(kept(content), lambda p: p["type"] == "reasoning")
    fine = lambda p: (p["representation"] == "provider_exposed_reasoning") & (p["claim"] == "chain_of_thought") & (p["visibility"] != "not_returned") & (F.length(p["source_field"]) > 0) & p["value"].isNotNull()
    return (F.size(parts) > 0) & F.coalesce(F.forall(parts, fine), F.lit(False))


def privacy_issues(content: Column) -> Column:
    parts = kept(content)
    uncleared = F.exists(parts, lambda p: ~p["status"].isin(*CLEARED))
    unresolved = F.exists(parts, lambda p: p["value"].isNull() & p["blob_ref"].isNotNull())
    found = F.array(F.when(unresolved, "BLOB_CONTENT_UNAVAILABLE"), F.when(uncleared, "CONTENT_NOT_PRIVACY_CLEARED"))
    return F.filter(found, lambda x: x.isNotNull())


def reasoning_texts(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One text a group: the values of its reasoning parts, each digest once, in the order of first sight. A digest is
    reduced to its first place before the group's texts are put together."""
    parts = events.select(*keys, *order, F.explode(kept(F.col("content"))).alias("p")).where("p.type = 'reasoning' AND p.value IS NOT NULL")
    first = parts.groupBy(*keys, F.col("p.sha256").alias("digest")).agg(F.min(F.struct(*order, F.col("p.ordinal").alias("ordinal"), F.col("p.value").alias("value"))).alias("f"))
    lines = F.array_sort(F.collect_list("f"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("text"), F.count("*").alias("parts"))


def export_view(events: DataFrame, scope: str) -> DataFrame:
    """The selected events and parts, with spans that hold redacted content under new keys everywhere: own span, parents,
    links (array of span ids). ``events``: trace_id, event_id, sequence, event_type, actor, span_id, parent_span_id, links,
    include, content. A re-keyed event loses its source id. Redacted spans are one row each and join three times."""
    chosen = events.where("include").where(~projection_excluded(F.col("event_type"), F.col("content"))).withColumn("content", kept(F.col("content")))
    # Counted here, so that callers that want no content don't move it.
    chosen = chosen.withColumn("parts", F.size("content").cast("long"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    identity = lambda what: F.concat(F.lit('{"actor":'), quoted(F.col("actor")), F.lit(',"event_type":'), quoted(F.col("event_type")), F.lit(f',"scope":"{scope}-{what}","sequence":'), F.col("sequence").cast("string"), F.lit(',"trace_id":'), quoted(F.col("trace_id")), F.lit("}"))
    hidden = chosen.where(F.exists("content", lambda p: p["status"] == "redacted"))
    # Of several redacted events in a span the last names it.
    spans = hidden.groupBy("trace_id", "span_id").agg(F.max_by(F.substring(F.sha2(identity("span"), 256), 1, 16), "sequence").alias("new_span"))
    out = chosen.join(spans, ["trace_id", "span_id"], "left")
    out = out.join(spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("new_span").alias("new_parent")), ["trace_id", "parent_span_id"], "left")
    links = chosen.select("trace_id", "event_id", F.posexplode("links").alias("at", "span_id")).join(spans, ["trace_id", "span_id"], "left")
    links = links.groupBy("trace_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new_span", "span_id").alias("span")))).alias("l"))
    out = out.join(links.select("trace_id", "event_id", F.col("l.span").alias("new_links")), ["trace_id", "event_id"], "left")
    new = F.col("new_span").isNotNull()
    return out.select(
        "trace_id", "sequence", "event_type", F.when(new, F.concat(F.lit("redacted:"), F.substring(F.sha2(identity("event"), 256), 1, 32))).otherwise(F.col("event_id")).alias("event_id"), new.alias("rekeyed"),
        F.coalesce("new_span", "span_id").alias("span_id"), F.coalesce("new_parent", "parent_span_id").alias("parent_span_id"), F.coalesce("new_links", F.array().cast("array<string>")).alias("links"), "content", "parts",
    )


def topology(events: DataFrame) -> DataFrame:
    """``trace_id, missing_parents, missing_links``: parents and links that name no span of the trace."""
    spans = events.select("trace_id", "span_id").distinct()
    parents = events.where("parent_span_id IS NOT NULL").select("trace_id", F.col("parent_span_id").alias("span_id"), F.lit("parent").alias("kind"))
    links = events.select("trace_id", F.explode("links").alias("span_id"), F.lit("link").alias("kind"))
    lost = parents.union(links).join(spans, ["trace_id", "span_id"], "left_anti")
    return lost.groupBy("trace_id").agg(F.count_if(F.col("kind") == "parent").alias("missing_parents"), F.count_if(F.col("kind") == "link").alias("missing_links"))


def linked(left: str, right: str) -> Column:
    """Whether two events (struct columns with span_id, parent_span_id, links) are one span, parent and child, or linked."""
    a, b = F.col(left), F.col(right)
    near = (a["span_id"] == b["span_id"]) | (a["parent_span_id"] == b["span_id"]) | (b["parent_span_id"] == a["span_id"])
    return F.coalesce(near, F.lit(False)) | F.array_contains(a["links"], b["span_id"]) | F.array_contains(b["links"], a["span_id"])


def call_names(events: DataFrame, trace: str, order: list[str], call: str) -> DataFrame:
    """``trace, call, name``: calls renamed call_0, call_1, ... in the order of first sight. One row a call is ranked."""
    first = events.where(F.col(call).isNotNull()).groupBy(trace, call).agg(F.min(F.struct(*order)).alias("first"))
    place = F.row_number().over(Window.partitionBy(trace).orderBy("first", call)) - 1
    return first.select(trace, call, F.concat(F.lit("call_"), place.cast("string")).alias("name"))


def approval_outcome(decision: Column, status: Column) -> Column:
    """The decision's word, else the event's status."""
    word = F.lower(decision)
    return (
        F.when(word.isin("allow", "allowed", "approve", "approved", "accept", "accepted"), "allow")
        .when(word.isin("deny", "denied", "reject", "rejected", "abort", "cancel", "cancelled") | status.isin("cancelled", "error"), "deny")
        .when(status == "ok", "allow")
        .otherwise("unknown")
    )


def is_retry(flag: Column, attempt: Column, reason: Column, lifecycle: Column) -> Column:
    named = lifecycle.rlike(r"(?i)(^|[./_-])retry($|[./_-])")
    return F.coalesce(flag, F.lit(False)) | F.coalesce(attempt > 1, F.lit(False)) | F.coalesce(reason != "", F.lit(False)) | F.coalesce(named, F.lit(False))


def compaction_phase(phase: Column) -> Column:
    word = F.lower(phase)
    return F.when(word.isin("start", "before", "precompact", "pre_compact"), "start").when(word.isin("end", "after", "postcompact", "post_compact", "complete", "completed"), "end")


_RUNNERS = "pytest|vitest|jest|(?:cargo|go|dotnet|mvnw?|gradlew?) +test|(?:npm|pnpm|yarn|bun) +(?:run +)?test"


def runs_tests(command: Column) -> Column:
    """A shell command that starts a test runner, alone or after a separator."""
    return F.coalesce(command.rlike(rf"(?i)(?:^|[\s;&|])(?:{_RUNNERS})\b"), F.lit(False))


def subagent_start(event_type: Column, lifecycle: Column, agent: Column) -> Column:
    return (event_type == "agent.invoke") & (F.coalesce(lifecycle.rlike("(?i)subagent|tool-workflow/agent-start"), F.lit(False)) | agent.isNotNull())


def duration_text(ms: Column) -> Column:
    tenths = F.round(ms / 1000, 1)
    return F.when(ms.isNull() | (ms < 0), "—").when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(ms < 10_000, F.format_string("%.1f s", tenths)).otherwise(F.format_string("%.0f s", F.round(ms / 1000)))


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KiB", F.round(n / 1024, 1))).otherwise(F.format_string("%.1f MiB", F.round(n / (1 << 20), 1)))


def short_id(x: Column, head: int = 8) -> Column:
    return F.when(F.length(x) <= head, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("…")))


def settled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Without the partial events of keys that also have a completed one: what was completed stands for its deltas."""
    whole = F.bool_or(F.col("status") != "partial").over(Window.partitionBy(*keys))
    return events.withColumn("_whole", whole).where((F.col("status") != "partial") | ~F.col("_whole")).drop("_whole")


def store_listing(versions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The current version of each trace of a managed store: the latest generation, without those deleted at or after
    it. ``versions``: trace_id, generation, digest; ``tombstones``: trace_id, generation."""
    last = versions.groupBy("trace_id").agg(F.max("generation").alias("generation"), F.max_by("digest", "generation").alias("digest"))
    dead = tombstones.groupBy("trace_id").agg(F.max("generation").alias("deleted"))
    return last.join(dead, "trace_id", "left").where("deleted IS NULL OR deleted < generation").drop("deleted")


def cover(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """``key, problem``: what keeps ``given`` from covering ``wanted`` exactly: missing, unexpected or repeated keys."""
    w, g = wanted.groupBy(key).agg(F.lit(True).alias("w")), given.groupBy(key).agg(F.count("*").alias("g"))
    problem = F.when(F.col("g").isNull(), "missing").when(F.col("w").isNull(), "unexpected").when(F.col("g") > 1, "repeated")
    return w.join(g, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def contiguous(shards: DataFrame, group: str, index: str) -> DataFrame:
    """``group, shards, whole``: whether the indexes are 0, 1, ... without gap or repeat."""
    of = shards.groupBy(group).agg(F.count("*").alias("shards"), F.count_distinct(index).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"))
    return of.select(group, "shards", ((F.col("low") == 0) & (F.col("n") == F.col("shards")) & (F.col("high") == F.col("shards") - 1)).alias("whole"))
