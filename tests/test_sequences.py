"""Closed forms against step-by-step versions on random input."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spoorlake.operators import sequences as S
from spoorlake.operators.components import connected_components
from spoorlake.operators.paths import leaf_paths
from spoorlake.operators.similarity import jaccard_pairs


@pytest.fixture(scope="module")
def trace(spark):
    r = random.Random(4)
    rows = [(f"t{t}", s, r.choice("cr"), f"k{r.randrange(3)}", f"e{t}-{s}") for t in range(30) for s in sorted(r.sample(range(60), r.randint(0, 25)))]
    return rows, spark.createDataFrame(rows, "t string, seq long, kind string, id string, e string").cache()


def per_trace(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out.items()


def test_greedy_pairs(trace):
    rows, df = trace
    want = set()
    for _, own in per_trace(rows):
        cursor = {}
        for _, seq, kind, key, e in own:
            if kind == "c":
                results = [x for x in own if x[2] == "r" and x[3] == key]
                i = cursor.get(key, 0)
                while i < len(results) and results[i][1] <= seq:
                    i += 1
                want.add((e, results[i][4] if i < len(results) else None))
                cursor[key] = i + (i < len(results))
    calls = df.where("kind = 'c'").withColumnRenamed("e", "call")
    results = df.where("kind = 'r'").withColumnRenamed("e", "result")
    assert {(x.call, x.result) for x in S.greedy_pairs(calls, results, ["t", "id"], "seq", "call", "result").collect()} == want


def test_parallel_activity(trace):
    rows, df = trace
    want = {}
    for t, own in per_trace(rows):
        active, inside, groups, extra, most = {}, False, 0, 0, 0
        for _, _, kind, key, _ in own:
            now = sum(active.values())
            if kind == "c":
                if now:
                    extra += 1
                    groups, inside = groups + (not inside), True
                active[key] = active.get(key, 0) + 1
                most = max(most, now + 1)
            else:
                active[key] = active.get(key, 0) - 1
                if active[key] <= 0:
                    del active[key]
                inside = inside and bool(active)
        want[t] = (groups, extra, most)
    got = S.parallel_activity(df, ["t"], "id", ["seq"], F.col("kind") == "c", F.col("kind") == "r")
    got = got.groupBy("t").agg(F.countDistinct(F.when(F.col("is_parallel"), F.col("busy"))), F.count_if("is_parallel"), F.max(F.when(F.col("kind") == "c", F.col("running") + 1).otherwise(0)))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_asof_and_first_after(trace):
    rows, df = trace
    left, right = df.where("kind = 'c'"), df.where("kind = 'r'").withColumn("found", F.col("seq"))
    back = {r.e: r.found for r in S.asof_backward(left, right, ["t"], "seq", ["found"]).collect()}
    next_ = {r.e: r.next_found for r in S.first_after(left, right, ["t"], "seq", ["found"]).collect()}
    for t, seq, kind, _, e in rows:
        if kind == "c":
            at = [x[1] for x in rows if x[0] == t and x[2] == "r"]
            assert back[e] == max((a for a in at if a <= seq), default=None) and next_[e] == min((a for a in at if a > seq), default=None)


def test_gaps_and_quarantine(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 4), ("b", 1), ("c", None)], "t string, seq long")
    assert {r.t: (r.gap_count, r.duplicate_count) for r in S.sequence_gaps(df, ["t"], "seq").collect()}["a"] == (2, 1)
    q = S.after_discontinuity(df.dropna(), ["t"], "seq", ["seq"]).groupBy("t").agg(F.count_if("quarantined"))
    assert {r[0]: r[1] for r in q.collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {n.node: n.component for n in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_leaf_paths(spark):
    rows = [("x", 1, None), ("x", 2, 1), ("x", 3, 2), ("x", 4, 2), ("x", 9, 77), ("y", 1, 2), ("y", 2, 1), ("y", 3, 2), *[("z", i, i - 1) for i in range(1, 40)]]
    got = {(r.k, r.leaf): r.path for r in leaf_paths(spark.createDataFrame(rows, "k string, node long, parent long"), ["k"]).collect()}
    assert got[("x", 3)] == [1, 2, 3] and got[("x", 4)] == [1, 2, 4] and got[("x", 9)] == [9] and got[("z", 39)] == [*range(1, 40)]
    assert set(got[("y", 3)]) == {1, 2, 3} and len(got) == 5


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_pairs(spark, seed):
    r = random.Random(seed)
    sets = [(i, sorted(r.sample(range(12), r.randint(0, 11)))) for i in range(60)]
    got = {(x.a, x.b): (x.intersection, x.similarity_bp) for x in jaccard_pairs(spark.createDataFrame(sets, "id long, features array<long>"), 6000).collect()}
    want = {}
    for a, x in sets:
        for b, y in sets:
            i, u = len({*x} & {*y}), len({*x} | {*y})
            if a < b and x and y and i * 10000 >= 6000 * u:
                want[a, b] = (i, i * 10000 // u)
    assert got == want


def test_jaccard_pairs_keep_only_features_that_sets_share(spark):
    """Features of one set alone, which most are, are neither written nor joined; nor are sets that have too few others."""
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(Path(where).glob("sets-*"))
    sets = [(i, [1000 * i + j for j in range(50)] + [-1, -2]) for i in range(40)] + [(100, [*range(-9, 0), -10]), (101, [*range(-9, 0), -11])]
    got = jaccard_pairs(spark.createDataFrame(sets, "id long, features array<long>"))
    assert [tuple(x) for x in got.collect()] == [(100, 101, 9, 11, 8181)]
    (made,) = set(Path(where).glob("sets-*")) - before
    assert {(x.id, *sorted(x.features)) for x in spark.read.parquet(str(made)).collect()} == {(i, *range(-9, 0)) for i in (100, 101)}
