"""Approximate nearest neighbours with an inverted multi-index.

Each half of the vectors has its own codebook (k-means on a bounded sample); a row lies in the cell of its two nearest
centroids. A query walks the cells in order of the summed distances of their centroids to its halves, with a heap over
the first centroids, each of which offers its next cell that has rows, until the cells hold the query's quota of rows.
Those rows are reranked by their exact distance.

The sample only fits the codebooks; every row is indexed. Cell sizes (at most ``CENTROIDS`` squared for each length of
vectors) steer the walk. The quota is a share of the table, so recall doesn't fade with size. The given vectors don't
cluster (their covariance has about equal eigenvalues), so what limits recall is how well cells approximate distances:
with 512 centroids a half and a quarter of the rows it is above 0.9, where 64 centroids needed 45 %. Vectors that do
cluster need a smaller share: both are parameters.

Where the walk ended is one number for each query, the summed distance of its last cell; so a query is sent as its
vector and that number to the regions (runs of first centroids) in which it has cells, and a region finds the rows. A
region has at most about ``CELL_ROWS`` rows: a first centroid with more is dealt over several tasks by a hash.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null
ids; rows equal in id and vector are one candidate; rows that share the query's id are not its candidates; a vector is
compared with vectors of its own length only (each length has its own codebooks, all in one job; a length of which the
sample has no row is one cell); ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bit_sliced import usable
from .common import batch, written

TOP, EVERY = 10, 100
#: Centroids of each half at most; sampled vectors for each centroid at least; vectors that fit them at most; k-means rounds.
CENTROIDS, EACH, SAMPLE, ROUNDS = 512, 2, 20_000, 12
#: Share of the rows that a query reranks.
SHARE = 0.25
#: Rows of one task's region, and queries with it, at most about.
CELL_ROWS, CELL_QUERIES = 65_536, 65_536


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from distinct sampled rows; an empty cluster takes the worst-fitted row."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        d = distances(x, centers)
        at = d.argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        worst = np.argsort(-d[np.arange(len(x)), at])
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[worst[:k]])
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared, rows x centers."""
    return np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * x @ centers.T, 0)


def _vectors(table) -> np.ndarray:
    column = table.column("v")
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(table.num_rows, -1)


class Codebooks:
    """Two codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS):
        self.half, k = sample.shape[1] // 2, max(1, min(centroids, len(sample) // EACH))
        self.a, self.b = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of rows."""
        parts = [x[at : at + 1024] for at in range(0, len(x), 1024)]
        return tuple(np.concatenate([distances(p[:, own], of).argmin(1) for p in parts]) for own, of in ((slice(self.half), self.a), (slice(self.half, None), self.b)))

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of one vector's halves to all centroids, the same wherever they are computed."""
        return ((self.a - v[: self.half]) ** 2).sum(1), ((self.b - v[self.half :]) ** 2).sum(1)


class Directory:
    """The cells that have rows: for each first centroid its second centroids, and the cells' sizes."""

    def __init__(self, i: np.ndarray, j: np.ndarray, n: np.ndarray):
        order = np.lexsort((j, i))
        self.firsts, starts = np.unique(i[order], return_index=True)
        self.seconds, self.sizes = np.split(j[order], starts[1:]), np.split(n[order], starts[1:])
        self.rows = np.array([x.sum() for x in self.sizes])

    def walk(self, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[float, int, int, int]]:
        """Cells ``(near[i] + far[j], i, j, size)`` by that sum, from a heap with one entry a first centroid."""
        heap, lists = [], []
        for k, (i, js, sizes) in enumerate(zip(self.firsts.tolist(), self.seconds, self.sizes)):
            order = np.argsort(far[js], kind="stable")
            sums = (near[i] + far[js][order]).tolist()
            lists.append((sums, i, js[order].tolist(), sizes[order].tolist()))
            heap.append((sums[0], k, 0))
        heapq.heapify(heap)
        while heap:
            cost, k, at = heap[0]
            sums, i, js, sizes = lists[k]
            yield cost, i, js[at], sizes[at]
            if at + 1 < len(sums):
                heapq.heapreplace(heap, (sums[at + 1], k, at + 1))
            else:
                heapq.heappop(heap)

    def reach(self, near: np.ndarray, far: np.ndarray, quota: int) -> tuple[float, np.ndarray]:
        """The sum at which the walk has ``quota`` rows, and the first centroids (places in ``firsts``) it then met."""
        held, last = 0, 0.0
        for last, _, _, size in self.walk(near, far):
            held += size
            if held >= quota:
                break
        least = near[self.firsts] + np.array([far[js].min() for js in self.seconds])
        return last, np.flatnonzero(least <= last)


def nearest(rows: DataFrame, queries: DataFrame, k: int = TOP, centroids: int = CENTROIDS, share: float = SHARE, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for written tables ``rows`` and ``queries`` of ``vec_id, v`` (array of double)."""
    spark = rows.sparkSession
    totals = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().collect()}  # one length, as a rule
    # The rows with the smallest hashes: the same sample however the table is split.
    fit: dict[int, list] = {}
    for v in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(sample).toArrow().column("v"):
        fit.setdefault(len(v), []).append(v.values.to_numpy())
    books = {dim: Codebooks(np.array(fit.get(dim, np.zeros((1, dim)))), centroids) for dim in totals}
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32())])

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        lengths = np.diff(b.column("v").offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            part = b if len(b) == (n := int((lengths == dim).sum())) else b.take(pa.array(np.flatnonzero(lengths == dim)))
            yield dim, part, _vectors(part).reshape(n, dim)

    def index(batches):
        for b in batches:
            for dim, part, x in by_length(b):
                i, j = books[dim].cells(x)
                yield batch(schema, [part.column("vec_id"), part.column("v"), np.full(len(x), dim), i, j])

    indexed = written(rows.select("vec_id", "v").mapInArrow(index, "vec_id long, v array<double>, dim int, i int, j int"), "cells")
    found = indexed.groupBy("dim", "i", "j").count().toArrow()  # at most centroids**2 rows for each length
    dims, i, j, n = (found.column(c).to_numpy() for c in ("dim", "i", "j", "count"))
    directories = {dim: Directory(i[dims == dim], j[dims == dim], n[dims == dim]) for dim in totals}
    # Runs of first centroids with about as many rows: regions, and the tasks that share a region.
    least, regions, parts = max(1, math.ceil(sum(totals.values()) / spark.sparkContext.defaultParallelism)), {}, []
    for dim, d in directories.items():
        held, of = 0, []
        for size in d.rows.tolist():
            if not of or held + size > min(cell_rows, least):
                parts.append(0)
                held = 0
            held += size
            of.append(len(parts) - 1)
            parts[-1] = math.ceil(held / cell_rows)
        regions[dim] = np.array(of, np.int32)
    # The query's own row takes no place in the quota, and a quota of k at least is needed for k neighbours.
    quota = {dim: max(math.ceil(share * total), k + 1) for dim, total in totals.items()}
    routes = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("reach", pa.float64()), ("region", pa.int32())])

    def route(batches):
        for b in batches:
            for dim, part, x in by_length(b):
                d, at, reaches, where = directories[dim], [], [], []
                for row, v in enumerate(x):
                    last, met = d.reach(*books[dim].near(v), quota[dim])
                    mine = np.unique(regions[dim][met])
                    at.append(np.full(len(mine), row))
                    reaches.append(np.full(len(mine), last))
                    where.append(mine)
                at = pa.array(np.concatenate(at))
                yield batch(routes, [part.column("vec_id").take(at), part.column("v").take(at), np.full(len(at), dim), np.concatenate(reaches), np.concatenate(where)])

    routed = queries.select("vec_id", "v").mapInArrow(route, "vec_id long, v array<double>, dim int, reach double, region int")
    groups = max(1, math.ceil(queries.count() / cell_queries))
    of_first = spark.createDataFrame([(dim, int(f), int(r)) for dim, d in directories.items() for f, r in zip(d.firsts, regions[dim])], "dim int, i int, region int")
    sizes = F.array(*[F.lit(int(p)) for p in parts]) if parts else F.array(F.lit(1))
    pieces = F.element_at(sizes, F.col("region") + 1)
    of = lambda size: F.pmod(F.xxhash64("vec_id", "v"), size).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), size - 1))
    # At most `centroids` rows for each length of vectors.
    left = indexed.join(F.broadcast(of_first), ["dim", "i"]).withColumn("g", of(pieces)).withColumn("h", every(F.lit(groups)))
    right = routed.withColumn("h", of(F.lit(groups))).withColumn("g", every(pieces))
    keys = ["region", "g", "h"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rerank(k, books), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # at most k rows a region and query
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rerank(k: int, books: dict[int, Codebooks]):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(cell: pa.Table, asked: pa.Table) -> pa.Table:
        if not cell.num_rows or not asked.num_rows:
            return schema.empty_table()
        book = books[cell.column("dim")[0].as_py()]
        ids, x, out = cell.column("vec_id").to_numpy(), _vectors(cell), []
        first, second = cell.column("i").to_numpy(), cell.column("j").to_numpy()
        for q, v, reach in zip(asked.column("vec_id").to_numpy().tolist(), _vectors(asked), asked.column("reach").to_numpy().tolist()):
            near, far = book.near(v)
            mine = np.flatnonzero((near[first] + far[second] <= reach) & (ids != q))
            d = np.sqrt(((x[mine] - v) ** 2).sum(1))
            m = min(k, len(d))
            if m:
                at = np.flatnonzero(d <= np.partition(d, m - 1)[m - 1])
                at = at[np.lexsort((ids[mine[at]], d[at]))][:k]
                out.append((np.full(len(at), q), ids[mine[at]], d[at]))
        return pa.Table.from_batches([batch(schema, [np.concatenate(c) for c in zip(*out)])]) if out else schema.empty_table()

    return run


def search_embeddings(rows: DataFrame, k: int = TOP, every: int = EVERY, **parameters) -> DataFrame:
    """Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates all other rows."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    fine = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    v = written(fine.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).distinct(), "vectors")
    return nearest(v, v.where(F.col("vec_id") % every == 0), k, **parameters)
