"""Order-dependent operators on event tables, as window expressions: as-of, pairing, open counters, islands.

All take the partition keys, the order columns and boolean conditions as parameters, add columns and keep the other
columns. Partitions are traces (or keys within traces); Spark spills their windows, and every operator of a trace can
reuse one exchange on the trace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def forward_fill(value: Column, keys: Sequence[str], order: Sequence) -> Column:
    """The last non-null value up to and including the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_UP_TO))


def asof_backward(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str], tie: str | None = None) -> DataFrame:
    """Adds the ``columns`` of the latest anchor at or before each row, with equal ``keys`` (nulls are equal). One
    union and one window: no inequality join."""
    marked = F.struct(*columns)
    shape = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    left = rows.select(*keys, F.col(seq).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_tie"), shape.alias("_row"))
    right = anchors.select(*keys, F.col(seq).alias("_at"), F.lit(0).alias("_kind"), (F.col(tie).cast("string") if tie else F.lit(None).cast("string")).alias("_tie"), marked.alias("_anchor"))
    both = left.unionByName(right, allowMissingColumns=True)
    filled = both.withColumn("_found", forward_fill(F.col("_anchor"), keys, ["_at", "_kind", "_tie"])).where("_kind = 1")
    return filled.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def greedy_pairs(calls: DataFrame, results: DataFrame, keys: Sequence[str], seq: str, call_id: str, result_id: str) -> DataFrame:
    """Every call with the first unused result after it, calls in order: ``keys, call_id, result_id`` (null: none).

    With f(i) results at or before call i, call i takes result i + max over j <= i of (f(j) - j): no iteration."""
    c = calls.select(*keys, F.col(seq).alias("_at"), F.col(call_id).alias("_call"), F.lit(None).cast("string").alias("_result"))
    r = results.select(*keys, F.col(seq).alias("_at"), F.lit(None).cast("string").alias("_call"), F.col(result_id).alias("_result"))
    both = c.unionByName(r)
    before = F.count("_result").over(Window.partitionBy(*keys).orderBy("_at").rangeBetween(*_UP_TO))
    both = both.withColumn("_f", before)
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "_call", "_result")) - 1
    left = both.where("_call IS NOT NULL").withColumn("_i", index)
    slack = F.max(F.col("_f") - F.col("_i")).over(Window.partitionBy(*keys).orderBy("_i").rowsBetween(*_UP_TO))
    left = left.select(*keys, F.col("_call").alias(call_id), (F.col("_i") + slack).alias("_m"))
    right = both.where("_result IS NOT NULL").select(*keys, F.col("_result").alias(result_id), index.alias("_m"))
    return left.join(right, [*keys, "_m"], "left").drop("_m")


def first_after(left: DataFrame, right: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Adds, with a prefix, the ``columns`` of the first ``right`` row strictly after each ``left`` row within ``keys``:
    the as-of window read backwards, so no inequality join."""
    shape = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(*keys, F.col(seq).alias("_at"), F.lit(1).alias("_kind"), shape.alias("_row"))
    b = right.select(*keys, F.col(seq).alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns).alias("_next"))
    both = a.unionByName(b, allowMissingColumns=True)
    # Descending: the rows seen so far lie after this one; at equal places the left row comes first.
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(*_UP_TO)
    found = both.withColumn("_found", F.last("_next", ignorenulls=True).over(w)).where("_kind = 1")
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in columns])


def open_count(up: Column, down: Column, keys: Sequence[str], order: Sequence) -> tuple[Column, Column]:
    """The counter that ``up`` raises and ``down`` lowers, never below zero, after each row; and its total sum so far
    of lost steps (downs at zero). open = S - min(0, min S)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_UP_TO)
    s = F.sum(F.when(up, 1).when(down, -1).otherwise(0)).over(w)
    return s, w


def open_counters(rows: DataFrame, up: Column, down: Column, keys: Sequence[str], order: Sequence, name: str = "open") -> DataFrame:
    """Adds ``name``: the floored counter of :func:`open_count` after each row."""
    s, w = open_count(up, down, keys, order)
    rows = rows.withColumn("_s", s)
    return rows.withColumn(name, F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def parallel_activity(rows: DataFrame, trace: Sequence[str], call: str, order: Sequence, is_call: Column, is_result: Column) -> DataFrame:
    """Adds ``running`` (calls open before the row), ``is_parallel`` and ``busy`` (number of the busy period).

    A call id's open count is floored at zero; a busy period ends with a result that leaves nothing open."""
    rows = rows.where(F.col(call).isNotNull() & (is_call | is_result))
    rows = open_counters(rows, is_call, is_result, [*trace, call], order, "_open")
    step = F.col("_open") - F.coalesce(F.lag("_open").over(Window.partitionBy(*trace, call).orderBy(*order)), F.lit(0))
    whole = Window.partitionBy(*trace).orderBy(*order)
    rows = rows.withColumn("_step", step).withColumn("_total", F.sum("_step").over(whole.rowsBetween(*_UP_TO)))
    ended = F.sum(F.when(is_result & (F.col("_total") == 0), 1).otherwise(0)).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("running", F.col("_total") - F.col("_step")).withColumn("busy", F.coalesce(ended, F.lit(0)))
    return rows.withColumn("is_parallel", is_call & (F.col("running") > 0)).drop("_open", "_step", "_total")


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence, member: Column, boundary: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run of consecutive ``member`` rows with an equal, non-null ``boundary`` (null: no
    member). A null boundary starts a run of its own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns({"_m": member, "_b": boundary})
    same = F.coalesce(F.lag("_m").over(w) & (F.lag("_b").over(w) == F.col("_b")), F.lit(False))
    rows = rows.withColumn("_new", F.when(F.col("_m") & ~same, 1).otherwise(0))
    number = F.sum("_new").over(w.rowsBetween(*_UP_TO))
    return rows.withColumn(name, F.when(F.col("_m"), number)).drop("_m", "_b", "_new")


def sequence_gaps(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Per key: absent sequence values between the observed ones, and repeated ones."""
    counts = rows.groupBy(*keys, seq).agg(F.count("*").alias("_n"))
    gap = F.greatest(F.lit(0), F.col(seq) - F.lag(seq).over(Window.partitionBy(*keys).orderBy(seq)) - 1)
    counts = counts.withColumn("_gap", F.coalesce(gap, F.lit(0)))
    return counts.groupBy(*keys).agg(F.sum("_gap").cast("long").alias("gap_count"), F.sum(F.col("_n") - 1).cast("long").alias("duplicate_count"))


def after_discontinuity(rows: DataFrame, keys: Sequence[str], seq: str, order: Sequence, start: int = 0) -> DataFrame:
    """Adds ``quarantined``: true from the first row whose sequence doesn't follow its predecessor's (the first row's
    must be ``start``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    broken = F.when(F.col(seq) == F.coalesce(F.lag(seq).over(w) + 1, F.lit(start)), 0).otherwise(1)
    return rows.withColumn("_broken", broken).withColumn("quarantined", F.max("_broken").over(w.rowsBetween(*_UP_TO)) == 1).drop("_broken")


def unique_after(rows: DataFrame, others: DataFrame, keys: Sequence[str], seq: str, tolerant: Sequence[str], row_id: str) -> DataFrame:
    """The ``rows`` (``keys, seq, row_id``) after which there is exactly one of ``others`` with equal ``keys`` and with
    ``tolerant`` columns that are equal or null on either side, with its place as ``found``.

    Instead of a join, each of the others stands under every key that a row may ask for (its own value or any, for each
    tolerant column), and a row asks under its own values and null; running counts then give the number of later ones. So
    a hot key costs a few rows for each of its rows, not a product."""
    ask, stand = [[]], [[]]
    any_, null = F.lit("*"), F.lit("-")
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), null)
    for c in tolerant:
        # A row with a null asks for any value; else for its own value, and for others' nulls.
        ask = [[*a, x] for a in ask for x in (F.when(F.col(c).isNull(), any_).otherwise(value(c)), F.when(F.col(c).isNotNull(), null))]
        stand = [[*a, x] for a in stand for x in (value(c), any_)]
    whole = lambda parts: F.when(F.forall(F.array(*parts), lambda x: x.isNotNull()), F.concat_ws("\x1f", *parts))
    left = rows.select(*keys, F.col(seq).alias("_at"), F.col(row_id).alias("_row"), F.explode(F.array_compact(F.array(*[whole(a) for a in ask]))).alias("_under"), F.lit(0).alias("_n"))
    right = others.select(*keys, F.col(seq).alias("_at"), F.lit(None).cast(rows.schema[row_id].dataType).alias("_row"), F.explode(F.array(*[F.concat_ws("\x1f", *a) for a in stand])).alias("_under"), F.lit(1).alias("_n"))
    later = Window.partitionBy(*keys, "_under").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    both = left.unionByName(right).withColumns({"_count": F.sum("_n").over(later), "_next": F.min(F.when(F.col("_n") == 1, F.col("_at"))).over(later)})
    found = both.where("_n = 0").groupBy(*keys, F.col("_at").alias(seq), F.col("_row").alias(row_id)).agg(F.sum("_count").alias("n"), F.min("_next").alias("found"))
    return found.where("n = 1").drop("n")
