"""Exact top-k search by inner product on a bit-sliced index.

Components are quantised to integers. A block of rows is indexed as bitmaps: one per attribute and bit of its value
(shifted to be non-negative). A query's inner product with all rows of a block is a weighted sum of these bitmaps, done
by carry-save addition of bitmaps (negative weights use the complement), which gives the slices of the sum. The top k
are then selected from the most significant slice downward: rows that are certain, and rows that tie so far. Whatever
remains on the boundary after the last slice has equal scores and is resolved exactly by the smaller id.

Queries are a stated set; each block answers all queries of a query block and returns its own top k, then the best k
over blocks are kept per query. Rows are dealt to blocks by a hash of id and vector, so a hot id or a hot vector
doesn't matter once equal (id, vector) rows are one. As the search is exact, every block of rows meets every query;
the blocks are as large as a task's memory allows, which keeps the copies of rows and queries few.

Sums are exact for components of any finite size: bitmaps and carries are as many as the numbers need, whatever a machine
word holds. Vectors with large components lie in blocks of their own, which have fewer rows. Scores are ordered by their
exact values; where one is beyond 64 bits, the nearest 64-bit integer is returned.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; rows equal in id
and vector are one candidate; rows that share the query's id are not its candidates; a vector is compared with vectors
of its own length only; null ids take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch

SCALE, TOP, EVERY = 256, 5, 50
#: Rows and queries of a block at most, about; rows of a block of large components, those of 2**LARGE or more.
BLOCK_ROWS, BLOCK_QUERIES, LARGE_ROWS, LARGE = 32_768, 65_536, 1024, 18


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def bit_slices(values: np.ndarray) -> list[np.ndarray]:
    """Bitmaps (64-bit words) of a column of non-negative integers, least significant first."""
    n = max(1, int(values.max()).bit_length()) if len(values) else 1
    padded = np.zeros(-(-len(values) // 64) * 64, values.dtype)
    padded[: len(values)] = values
    return [np.packbits((padded >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(n)]


class BitSlicedIndex:
    """Bitmaps of a block of integer vectors (64-bit, or objects where they need more)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        self.low = vectors.min(axis=0)
        self.slices = [bit_slices(column) for column in (vectors - self.low).T]
        self.flipped = [[~s for s in slices] for slices in self.slices]
        self.top = [(1 << len(s)) - 1 for s in self.slices]
        self.rows = bit_slices(np.ones(len(ids), np.int64))[0]

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of (inner product - constant), which is non-negative, and the constant."""
        bits = max(abs(q).bit_length() + len(s) for q, s in zip(query.tolist(), self.slices))
        levels: list[list[np.ndarray]] = [[] for _ in range(bits + len(self.slices).bit_length() + 1)]
        constant = 0
        for d, q in enumerate(query.tolist()):
            constant += q * int(self.low[d])
            slices = self.slices[d]
            if q < 0:
                constant += q * self.top[d]
                q, slices = -q, self.flipped[d]
            while q:
                shift = (q & -q).bit_length() - 1
                q &= q - 1
                for b, s in enumerate(slices):
                    levels[shift + b].append(s)
        out = []
        levels.append([])  # no carry reaches it
        for i, level in enumerate(levels[:-1]):
            while len(level) > 2:  # three bitmaps of one weight make a sum and a carry
                a, b, c = level.pop(), level.pop(), level.pop()
                x = a ^ b
                level.insert(0, x ^ c)
                levels[i + 1].append((a & b) | (x & c))
            if len(level) == 2:
                a, b = level.pop(), level.pop()
                level.append(a ^ b)
                levels[i + 1].append(a & b)
            out.append(level[0] if level else np.zeros_like(self.rows))
        while len(out) > 1 and not out[-1].any():
            out.pop()
        return out, constant

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows whose id isn't the query's."""
        slices, constant = self.scores(query)
        sure, tied = np.zeros_like(self.rows), self.rows.copy()
        own = np.arange(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right"))
        for i in own:
            tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        n_sure = 0
        for s in reversed(slices):
            high = tied & s
            n = int(np.bitwise_count(high).sum())
            if n_sure + n >= k:
                tied = high
                if n_sure + n == k:
                    break
            else:
                sure, n_sure, tied = sure | high, n_sure + n, tied & ~s
        places = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
        chosen = np.concatenate((places(sure), places(tied)[: k - n_sure]))
        wide = object if max(len(slices), constant.bit_length()) > 62 else np.int64
        score = np.full(len(chosen), constant, wide)
        for i, s in enumerate(slices):
            score += (s[chosen >> 6] >> (chosen & 63).astype(np.uint64) & np.uint64(1)).astype(wide) << i
        return self.ids[chosen], score


def sort_key(n: int) -> bytes:
    """Bytes that are ordered as the integers are."""
    size = (abs(n).bit_length() + 7) // 8
    raw = abs(n).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + raw if n >= 0 else (0x8000 - size).to_bytes(2, "big") + bytes(255 - b for b in raw)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's own if one is too large for sums of products in 64 bits."""
    room = 2.0 ** ((62 - x.shape[1].bit_length()) // 2)
    scaled = np.floor(x * float(scale)) if len(x) and np.abs(x).max() < room / scale else None
    if scaled is not None:
        return scaled.astype(np.int64)
    # A double of 2**53 or more is an integer; below, the product is exact.
    exact = lambda v: math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale
    return np.array([exact(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, large_rows: int = LARGE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``rows`` and ``queries`` of ``vec_id, v`` (array of float or double)."""
    large = F.exists("v", lambda x: F.abs(x) >= 2.0**LARGE)
    rows, queries = (x.select("vec_id", "v", F.size("v").alias("dim"), large.alias("large")).distinct() for x in (rows, queries))
    counts = {r[0]: r[1] for r in rows.groupBy("large").count().collect()}
    usual, wide, m = math.ceil(counts.get(False, 0) / block_rows), math.ceil(counts.get(True, 0) / large_rows), queries.count()
    blocks = max(1, usual + wide)
    # Query blocks: few, as each takes a copy of all rows, but at least enough for all cores.
    h = max(1, math.ceil(m / block_queries), min(math.ceil(rows.sparkSession.sparkContext.defaultParallelism / blocks), m // 8))
    part = lambda size: F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, size)))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    block = F.when(F.col("large"), part(wide) + usual).otherwise(part(usual)).cast("int")
    left = rows.select("vec_id", "v", "dim", block.alias("g"), every(h).alias("h"))
    right = queries.select("vec_id", "v", "dim", every(blocks).alias("g"), part(h).cast("int").alias("h"))

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        ids, x = _arrays(block)
        index = BitSlicedIndex(ids, quantised(x, scale))
        out = []
        for q, v in zip(*_arrays(asked)):
            ids, scores = index.search(int(q), quantised(v[None], scale)[0], k)
            out += [(q, i, min(max(s, -(2**63)), 2**63 - 1), sort_key(s)) for i, s in zip(ids.tolist(), scores.tolist())]
        return pa.Table.from_batches([batch(_FOUND, [*zip(*out)])]) if out else _FOUND.empty_table()

    keys = ["g", "h", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long, key binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")  # k rows a block and query
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = pa.chunked_array([c.flatten() for c in table.column("v").chunks]).to_numpy()
    return table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1).astype(np.float64)


def vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v`` of the usable vectors; floats stay floats on their way."""
    kind = rows.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding") if kind in ("float", "double") else F.transform("embedding", lambda x: x.cast("double"))
    return rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def search_embeddings(rows: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, **parameters) -> DataFrame:
    """Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates all other rows."""
    v = vectors(rows)
    return top_k(v, v.where(F.col("vec_id") % every == 0), k, scale, **parameters)
