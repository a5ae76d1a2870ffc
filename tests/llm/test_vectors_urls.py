"""Vector searches and the URL filter against brute force."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest

from spoorlake.llm import bit_sliced, multi_index, url_filter


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)], "x") for i in range(300)]
    out += [(300 + i, out[i % 3][1], "tie") for i in range(6)]  # equal vectors under several ids
    out += [out[50], out[50]]  # repeated rows
    out += [(50, [0.5] * 6, "same id"), (400, None, None), (450, [0.1, None, 0.0, 0.0, 0.0, 0.0], ""), (500, [float("nan")] * 6, ""), (550, [float("inf")] + [0.0] * 5, ""), (None, [0.1] * 6, ""), (600, [], ""), (650, [0.0] * 6, "")]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, score string").cache()


def usable(rows, zero=True):
    out = {}
    for r in rows.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[r.vec_id, tuple(v)] = 1
    return [*out]


def test_bit_sliced_search_is_exact(rows):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in usable(rows)]
    want = set()
    for q, a in v:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)[:5]
            want |= {(q, tuple(a), k + 1, -s, i) for k, (s, i) in enumerate(best)}
    got = bit_sliced.search_embeddings(rows).collect()
    single = {q for q, _ in v if sum(i == q for i, _ in v) == 1}  # a query id with two vectors has the best of both
    assert {(r.query_id, r.rank, r.score, r.vec_id) for r in got if r.query_id in single} == {(q, k, s, i) for q, _, k, s, i in want if q in single}
    small = bit_sliced.search_embeddings(rows, block_rows=40, block_queries=2)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in got}
    assert bit_sliced.search_embeddings(rows.limit(0)).count() == 0


def test_components_of_any_finite_size(spark):
    rng = np.random.default_rng(9)
    sizes = [1.0, 1e5, 1e8, 1e12, 1e30, 1e200, 1.7e308]
    v = [(i, [float(x) for x in rng.normal(0, 1, 5) * (sizes[i % 7] if i % 3 else 1.0)]) for i in range(120)]
    v += [(120, [1.7e308] * 5), (121, [-1.7e308] * 5), (122, [5e-324, -5e-324, 0.0, 1.0, -1.0]), (123, [2.0**18] * 5), (124, [2.0**54 + 4] * 5)]
    v = [(i, [min(max(x, -1.7e308), 1.7e308) for x in e]) for i, e in v]
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    exact = {i: [math.floor(Fraction(x) * 256) for x in e] for i, e in v}
    want = set()
    for q in (i for i in exact if i % 10 == 0):
        best = sorted((-sum(x * y for x, y in zip(exact[q], exact[i])), i) for i in exact if i != q)[:5]
        want |= {(q, k + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(best)}
    for blocks in ({}, {"block_rows": 20, "large_rows": 7, "block_queries": 3}):
        assert {tuple(r) for r in bit_sliced.search_embeddings(table, every=10, **blocks).collect()} == want
    keys = [-(10**40), -(2**64), -257, -256, -1, 0, 1, 255, 256, 2**63, 10**40]
    assert sorted(keys, key=bit_sliced.sort_key) == keys


@pytest.mark.parametrize("seed", range(5))
def test_sums_of_slices(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, (200, 9))
    index = bit_sliced.BitSlicedIndex(np.arange(200), x)
    q = rng.integers(-90, 90, 9)
    ids, scores = index.search(7, q, 200)
    want = {i: int(s) for i, s in enumerate(x @ q) if i != 7}
    assert dict(zip(ids.tolist(), scores.tolist())) == want


def test_multi_index_scores_and_recall(rows, spark):
    v = usable(rows, zero=False)
    got = multi_index.search_embeddings(rows, share=0.5, centroids=8).collect()
    hit = total = 0
    for q, a in v:
        if q % 100 == 0:
            d = sorted((math.dist(a, b), i) for i, b in v if i != q)[:10]
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
            for r in mine:
                assert min(abs(math.dist(a, b) - r.score) for i, b in v if i == r.vec_id) < 1e-12
            hit += len({i for _, i in d} & {r.vec_id for r in mine})
            total += 10
    assert hit / total >= 0.9
    assert multi_index.search_embeddings(rows.limit(0)).count() == 0
    everything = {tuple(r) for r in multi_index.search_embeddings(rows, share=1.0).collect()}
    assert {(r[0], r[2]) for r in everything} >= {(q, i) for q, a in v if q % 100 == 0 for _, i in sorted((math.dist(a, b), i) for i, b in v if i != q)[:5]}
    # Regions that several tasks share, and several blocks of queries.
    assert {tuple(r) for r in multi_index.search_embeddings(rows, share=1.0, cell_rows=25, cell_queries=2).collect()} == everything
    mixed = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=1 + i % 4)]) for i in range(400)], "vec_id long, embedding array<double>")
    of = {r.vec_id: r.embedding for r in mixed.collect()}
    found = multi_index.search_embeddings(mixed, share=1.0, every=20).collect()
    for q in range(0, 400, 20):
        want = sorted((math.dist(of[q], e), i) for i, e in of.items() if i != q and len(e) == len(of[q]))[:10]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in want]


def test_walk_visits_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    near, far = rng.random(7), rng.random(5)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(7), np.arange(5), indexing="ij"))
    full = multi_index.Directory(i, j, np.ones(35, int))
    cells = [*full.walk(near, far)]
    assert {c[1:3] for c in cells} == {*zip(i.tolist(), j.tolist())} and [c[0] for c in cells] == sorted(near[a] + far[b] for a, b in zip(i, j))
    some = multi_index.Directory(np.array([3, 0, 3]), np.array([1, 4, 2]), np.array([5, 6, 7]))
    walked = [*some.walk(near, far)]
    assert sorted(c[1:] for c in walked) == [(0, 4, 6), (3, 1, 5), (3, 2, 7)] and [c[0] for c in walked] == sorted(c[0] for c in walked)
    last, met = some.reach(near, far, 6)
    assert last in {c[0] for c in walked} and sum(c[3] for c in walked if c[0] <= last) >= 6 and len(met)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    got = multi_index.search_embeddings(table).collect()
    hit = 0
    queries = [q for q in x if q % 100 == 0]
    for q in queries:
        d = sorted((np.sqrt(((x[q] - b) ** 2).sum()), i) for i, b in x.items() if i != q)[:10]
        hit += len({i for _, i in d} & {r.vec_id for r in got if r.query_id == q})
    assert hit / (10 * len(queries)) >= 0.9


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def test_url_rules_and_parts(spark):
    urls = [None, "", "no scheme", "https://", "http://A.Example.NET/en/x", "http://example.net/en", "http://example.netx/en/", "http://b.example.com/de/1?x#y", "http://x.org/fr/2", "http://x.org?q=/fr/", "ftp://ÄB.net#z", "a://b://c/d", "http://h.com/p\nq?r", "http://www.big-casino-pills.example.com/en/1", "http://quiet-garden.example.org/en/2"]
    pages = spark.createDataFrame([(i, u, "v", "h") for i, u in enumerate(urls)] + [(3, urls[3], "v", "h")], "page_id long, url string, verdict string, host string")
    weights = url_filter.train(spark)
    got = url_filter.judge(pages, weights).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = brute_parts(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else ("block" if r.probability > 0.5 else "allow"))
    by = {r.page_id: r for r in got}
    assert by[13].verdict == "block" and by[14].verdict == "allow"
    assert url_filter.judge(pages.limit(0), weights).count() == 0


def test_url_model_on_held_out_names(spark):
    names = sorted({name for name, _ in url_filter.NAMED})
    right = []
    for fold in range(3):
        held = {n for i, n in enumerate(names) if i % 3 == fold}  # a name's urls are all in or all out
        train = [r for r, (name, _) in zip(url_filter.LABELLED, url_filter.NAMED) if name not in held]
        rest = [r for r, (name, _) in zip(url_filter.LABELLED, url_filter.NAMED) if name in held]
        got = url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rest)], "page_id long, url string"), url_filter.train(spark, train), rules=())
        right += [(r.verdict == "block") == rest[r.page_id][1] for r in got.collect()]
    assert len(right) == len(url_filter.LABELLED) and np.mean(right) > 0.85, np.mean(right)
    assert url_filter.train(spark, []) == [0.0] * (url_filter.BUCKETS + 1)
    with pytest.raises(ValueError):
        url_filter.train(spark, [("https://a.example.com/", 0)] * (url_filter.MOST + 1))


def test_labelled_names_are_not_those_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").distinct().collect()
    labels = {part for r in pages for part in brute_parts(r.url)[0].split(".")}
    assert not labels & {name for name, _ in url_filter.NAMED}


def features_by_hand(host, path):
    out = set()
    for prefix, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        part = re.sub("[0-9]+", "0", part)
        out |= {(prefix, part[i : i + n]) for n in url_filter.SIZES for i in range(len(part) - n + 1)}
    return out


def test_training_is_logistic_regression_on_hashed_grams(spark):
    """Descent on the weights of the hashed features themselves, instead of the dual."""
    from pyspark.sql import functions as F

    labelled = url_filter.LABELLED[::7]
    grams = [features_by_hand(*brute_parts(u)) for u, _ in labelled]
    every = sorted(set().union(*grams))
    table = spark.createDataFrame(every, "prefix string, gram string")
    bucket = {(r.prefix, r.gram): r.b for r in table.select("prefix", "gram", F.pmod(F.xxhash64("prefix", *[F.substr("gram", F.lit(i + 1), F.lit(1)) for i in range(3)], F.substr("gram", F.lit(4), F.lit(1))), F.lit(url_filter.BUCKETS)).alias("b")).collect()}
    x = np.zeros((len(labelled), url_filter.BUCKETS + 1))
    for row, g in zip(x, grams):
        own = {bucket[e] for e in g}
        row[list(own)] = 1 / math.sqrt(len(own))
    x[:, -1] = 1
    y, w = np.array([v for _, v in labelled], float), np.zeros(url_filter.BUCKETS + 1)
    for _ in range(url_filter.STEPS):
        w = w * (1 - url_filter.RATE * url_filter.RIDGE) - url_filter.RATE / len(y) * x.T @ (1 / (1 + np.exp(-x @ w)) - y)
    assert np.allclose(url_filter.train(spark, labelled), w, atol=1e-9)
    got = url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id long, url string"), url_filter.train(spark, labelled)).collect()
    assert np.allclose([r.probability for r in sorted(got, key=lambda r: r.page_id)], 1 / (1 + np.exp(-x @ w)), atol=1e-9)


def test_a_very_long_url(spark):
    import time

    weights = url_filter.train(spark)
    urls = ["https://a.example.com/" + "x1é/" * 250_000, "https://" + "b" * 1_000_000]
    began = time.time()
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), weights).collect()}
    assert time.time() - began < 60
    assert len(got[0].path) == 1_000_001 and len(got[1].host) == 1_000_000
