"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents with an equal link key are neighbours. All start in the shard of a hash; in each round every group of
neighbours votes by counts per shard, less a share of the shard's load, and its members move to the shard that wins, as
far as the quotas allow: the driver scales the (shards x shards) flow matrix until no shard has more linked rows than
its quota, and groups are thinned to that share by a hash, so that whole groups move or wait for the next round. Last,
each shard keeps its first quota of rows, linked rows before lone ones, and the rows beyond fill the shards that have
room; so counts differ by one at most, and lone rows pay for the balance.

Groups larger than a whole quota are split first by a hash of the row (one group may hold a third of all rows). Ranks
come from counts per bucket, never from a window over a whole shard; a bucket has whole groups, or a part of one group
that is larger than a bucket.

Defined results: null text counts as empty (size 8, crc32 0) and is a neighbour of empty texts; rows are told apart by
their place, so repeated rows and null ids each get a slot of their own; extra columns are ignored; an empty table
gives no rows. With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import erased, written

SHARDS = 24
ROUNDS = 8
#: What a full shard loses of a vote, as a share of the group.
LOAD = 0.25
#: Rows that one task ranks, about.
BUCKET_ROWS = 100_000


def _at(values: list[int], index: Column) -> Column:
    """``values[index]``; one entry a shard."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (index + 1).cast("int"))


def allowed(flows: dict[tuple[int, int], int], sizes: list[int], caps: list[float]) -> dict[tuple[int, int], float]:
    """The largest shares of the wished flows, by repeated scaling, with which no shard exceeds its cap (or its size,
    where that is above the cap already). Less inflow somewhere means less outflow elsewhere, so it is repeated until
    nothing changes; shares only fall."""
    share = {pair: 1.0 for pair in flows}
    for _ in range(200):
        changed = False
        for j, size in enumerate(sizes):
            inward = sum(flows[p] * share[p] for p in flows if p[1] == j)
            outward = sum(flows[p] * share[p] for p in flows if p[0] == j)
            room = max(caps[j], size) - size + outward
            if inward > room + 1e-9:
                for p in flows:
                    if p[1] == j:
                        share[p] *= max(room, 0) / inward
                changed = True
        if not changed:
            break
    return share


def _sizes(state: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in state.groupBy("shard").count().collect()}
    return [found.get(j, 0) for j in range(shards)]


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, load: float = LOAD) -> DataFrame:
    """``rows`` is a written table with a unique long ``row`` and a ``link`` (null: no neighbours). Adds ``shard`` and
    ``slot``, counts at most one apart."""
    n = rows.count()
    quota = [n // shards + (j < n % shards) for j in range(shards)]
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    whole = max(1, n // shards)
    groups = written(rows.where("link IS NOT NULL").groupBy("link").count().where("count > 1"), "groups")
    linked = rows.join(groups, "link", "left")  # skewed links: AQE splits, the group side is one row a link
    parts = F.ceil(F.col("count") / whole)
    hub = F.when(F.col("count").isNotNull(), F.xxhash64("link", F.pmod(F.xxhash64("row"), parts)))
    # Where a row is ranked in the end: with its whole hub, unless that is larger than a task should rank.
    pieces = F.greatest(F.ceil(F.col("count") / parts / BUCKET_ROWS), F.lit(1))
    at = F.when(hub.isNotNull(), F.xxhash64(hub, F.pmod(F.xxhash64("row", F.lit("rank")), pieces))).otherwise(F.xxhash64("row"))
    state = linked.select("row", hub.alias("hub"), at.alias("at"), F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).cast("int").alias("shard"))
    state = written(state, "state")
    for k in range(rounds):
        sizes = _sizes(state.where("hub IS NOT NULL"), shards)
        penalty = [round(1000 * load * size / max(q, 1)) for size, q in zip(sizes, quota)]
        votes = state.where("hub IS NOT NULL").groupBy("hub", "shard").count()
        members = votes.groupBy("hub").agg(F.sum("count").alias("members"), F.collect_list(F.struct("count", "shard")).alias("votes"))  # one entry a shard
        turn = lambda shard: F.pmod(shard + F.pmod(F.col("hub"), F.lit(shards)), F.lit(shards))  # noqa: E731  ties: another shard for each group
        scored = F.transform("votes", lambda v: F.struct((1000 * v["count"] / F.col("members") - _at(penalty, v["shard"])).alias("score"), turn(v["shard"]).alias("turn"), v["shard"].alias("shard")))
        wishes = members.select("hub", F.array_max(scored)["shard"].alias("wish"))
        moving = state.where("hub IS NOT NULL").join(wishes, "hub").select("row", "hub", "at", "shard", "wish")
        moving = written(moving, "wishes")
        flows = {(r[0], r[1]): r[2] for r in moving.where("shard <> wish").groupBy("shard", "wish").count().collect()}
        if not flows:
            erased(moving)
            break
        share = allowed(flows, sizes, quota)
        table = [round(1_000_000 * share.get((i, j), 0)) for i in range(shards) for j in range(shards)]
        part = F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(1_000_000))
        goes = part < _at(table, F.col("shard") * shards + F.col("wish"))
        moved = moving.select("row", "hub", "at", F.when(goes, F.col("wish")).otherwise(F.col("shard")).alias("shard"))
        before, state = state, written(state.where("hub IS NULL").union(moved), "state")
        erased(before, moving)
    return rows.join(_settle(state, quota), "row")


def _settle(state: DataFrame, quota: list[int]) -> DataFrame:
    shards, n = len(quota), sum(quota)
    sizes = _sizes(state, shards)
    over = [max(0, s - q) for s, q in zip(sizes, quota)]
    before = [sum(over[:j]) for j in range(shards)]
    room = [max(0, q - s) for s, q in zip(sizes, quota)]
    opens = [sum(room[:j]) for j in range(shards)]
    buckets = max(1, math.ceil(n / shards / BUCKET_ROWS))
    state = state.withColumns({"lone": F.col("hub").isNull(), "bucket": F.pmod("at", F.lit(buckets))})
    group = ["shard", "lone", "bucket"]
    sums = Window.partitionBy("shard").orderBy("lone", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = state.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("first"))
    ranked = state.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("hub", "row")) - 1)
    rank = F.col("first") + F.col("r")
    ranked = ranked.join(firsts, group).select("row", "shard", rank.alias("rank"))
    index = _at(before, F.col("shard")) + F.col("rank") - _at(quota, F.col("shard"))
    kept = ranked.where(F.col("rank") < _at(quota, F.col("shard"))).select("row", "shard", F.col("rank").alias("slot"))
    moved = ranked.where(F.col("rank") >= _at(quota, F.col("shard"))).select("row", index.alias("i"))
    target = None  # the last shard with room whose room opens at or before i
    for j in range(shards):
        if room[j]:
            target = F.when(F.col("i") >= opens[j], F.lit(j)) if target is None else F.when(F.col("i") >= opens[j], F.lit(j)).otherwise(target)
    if target is None:
        return kept
    moved = moved.withColumn("shard", target)
    return kept.union(moved.select("row", "shard", _at(sizes, F.col("shard")) + F.col("i") - _at(opens, F.col("shard"))))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, load: float = LOAD) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: equal texts are neighbours. Texts are read once,
    for their sizes and digests; only those are shuffled."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("link"), F.monotonically_increasing_id().alias("row"),
    )
    out = propagate(written(rows, "rows"), shards, rounds, load)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
