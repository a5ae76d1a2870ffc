"""Language-model scoring by deleted interpolation.

P(w | history) mixes maximum-likelihood estimates of order ``n`` down to 1 and a uniform share 1/(V+1); the weights
depend on how often the history was seen (a bucket per power of two). They are learned by expectation-maximisation on a
held-out tenth of the training documents, whose counts are deleted from the estimates meanwhile; scores then use the
counts of all training documents.

The corpus never leaves the cluster and is counted whole. A task turns its texts into blocks (documents, word codes,
64-bit word hashes). For one order after the other, blocks send their sorted distinct n-gram keys to key ranges; a range
adds up the counts and sends them back in each block's own order; so what is shuffled is one key per block and distinct
n-gram, not one per occurrence, a frequent n-gram is no larger than a rare one, and the keys of one order are off the
disk before the next order's are sent. Weights are learned from a histogram of quantised estimates with their means.

A message has about ``block_tokens * range_keys / tokens`` keys: some 300 at 30 GB of text with the sizes below, which
suit executors of 3 GB. Larger executors should be given larger blocks and ranges.

Defined results: null or empty text is the one token ``end``; a null ``doc_id`` is treated as the empty id text (a
training document); repeated rows count and are scored as often as they occur; without training documents N = V = 0
and every estimate is uniform. Distinct n-grams are told apart by 64-bit hashes: among a
million million distinct n-grams, one in ten million is expected to be taken for another. A single text is never cut, so
a task holds the longest text of the table at least.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, erased, partition_id, release, texts_of, written

ORDER = 3
MODULUS, HELD = 7, 2
#: One training document in so many teaches the weights.
FOLDS = 10
#: Tokens of a block and distinct-key budget of a range, about.
BLOCK_TOKENS, RANGE_KEYS = 1_500_000, 1_500_000
BUCKETS = 65
#: Quantisation of estimates in the weights' histogram: steps per factor of two.
STEPS = 1
#: Partitions for each range and each block: so many that a task seldom gets two or three of them.
SPREAD = 8, 4

TRAIN, TEACH, TEST = 0, 1, 2
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def part_of(doc_id: int | None) -> int:
    """TEST for held-out documents, TEACH for those that teach the weights, else TRAIN."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return TEST if h % MODULUS == HELD else TEACH if h // MODULUS % FOLDS == 0 else TRAIN


def _pack(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(b: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(b, max_output_size=max(n * size, 1)), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


_BLOCK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())])
_BLOCK_DDL = "block long, part int, docs array<long>, lengths array<long>, tokens long, n_words long, words binary, codes binary"


def blocks_of(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Code 0 ends a document, code i is the block's i-th word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = partition_id(), 0
        fresh = lambda: {"docs": [], "lengths": [], "tokens": 0, "codes": [], "words": _Codes()}
        open_blocks = {p: fresh() for p in (TRAIN, TEACH, TEST)}

        def close(p: int) -> pa.RecordBatch:
            nonlocal made
            o, open_blocks[p] = open_blocks[p], fresh()
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in o["words"]), np.uint64, len(o["words"]))
            codes = np.concatenate(o["codes"])
            made += 1
            return batch(_BLOCK, [[(task << 24) + made], [p], [o["docs"]], [o["lengths"]], [o["tokens"]], [len(words)], [_pack(words)], [_pack(codes)]])

        for b, texts in texts_of(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), texts):
                p = part_of(doc)
                o = open_blocks[p]
                words = text.encode("utf-8", "surrogatepass").lower().split()
                codes = np.zeros(len(words) + 1, np.uint32)
                codes[:-1] = [*map(o["words"].__getitem__, words)]
                o["docs"].append(doc)
                o["lengths"].append(len(codes))
                o["codes"].append(codes)
                o["tokens"] += len(codes)
                if o["tokens"] >= block_tokens:
                    yield close(p)
        for p in (TRAIN, TEACH, TEST):
            if open_blocks[p]["docs"]:
                yield close(p)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCK_DDL)


class _Grams:
    """The n-grams of a block: per order each token's place among the sorted distinct keys."""

    def __init__(self, row: dict, order: int):
        self._of(row)
        hashes, codes = self.hashes, self.codes
        by = np.argsort(hashes, kind="stable")
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.at = [place[codes]]
        for key in self._keys(order):
            _, at = np.unique(key, return_inverse=True)
            self.at.append(at.reshape(-1).astype(np.int32))
        del self.hashes, self.codes

    @classmethod
    def distinct(cls, row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys of ``k + 1`` words, and their counts."""
        self = cls.__new__(cls)
        self._of(row)
        if not k:
            by = np.argsort(self.hashes, kind="stable")
            return self.hashes[by], np.bincount(self.codes, minlength=len(by))[by]
        for key in self._keys(k + 1):
            last = key
        return np.unique(last, return_counts=True)

    def _of(self, row: dict) -> None:
        words, codes = _unpack(row["words"], "<u8", row["n_words"]), _unpack(row["codes"], "<u4", row["tokens"])
        lengths = np.array(row["lengths"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.first = np.zeros(len(codes), bool)
        self.first[self.starts] = True
        self.hashes, self.codes = np.concatenate((np.array([_END]), words)), codes

    def _keys(self, order: int) -> Iterator[np.ndarray]:
        """Each token's key of two words, of three, up to ``order``."""
        own = self.hashes[self.codes]
        key, start = own, _START
        for _ in range(1, order):
            before = np.empty_like(key)
            before[1:], before[self.first] = key[:-1], start
            with np.errstate(over="ignore"):
                key, start = _mix(before, own), _mix(start, _START)
            yield key


def _mix(a, b):
    x = a * _K1 + b
    x = x ^ (x >> np.uint64(31))
    x = x * _K2
    return x ^ (x >> np.uint64(32))


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _sent(blocks: DataFrame, k: int, bits: int) -> DataFrame:
    """Each block's keys of ``k + 1`` words, cut into ranges."""
    schema = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                keys, counts = _Grams.distinct(row, k)
                cuts, counts, rows = _cuts(keys, bits), counts.astype("<u4"), []
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[r], cuts[r + 1])
                    sums = b"" if row["part"] == TEST else _pack(counts[own])
                    rows.append((r, row["block"], row["part"], cuts[r + 1] - cuts[r], _pack(np.diff(keys[own], prepend=np.uint64(0))), sums))
                yield batch(schema, [*zip(*rows)])
        release()

    return blocks.drop("docs").mapInArrow(run, "range long, block long, part int, n long, keys binary, counts binary")


_BACK = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("n", pa.int64()), ("seen", pa.binary()), ("taught", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64()), ("total_taught", pa.int64())])
_BACK_DDL = "block long, range long, n long, seen binary, taught binary, total long, distinct long, total_taught long"


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """All blocks' keys of one range: totals of the training documents, and of those that teach the weights."""
    range_ = key[0].as_py()
    rows = table.select(["block", "part", "n", "keys", "counts"]).to_pylist()
    keys = np.concatenate([np.cumsum(_unpack(r["keys"], "<u8", r["n"]), dtype=np.uint64) for r in rows])
    counts = np.concatenate([np.zeros(r["n"], "<u4") if r["part"] == TEST else _unpack(r["counts"], "<u4", r["n"]) for r in rows])
    teaches = np.concatenate([np.full(r["n"], r["part"] == TEACH) for r in rows])
    distinct, at = np.unique(keys, return_inverse=True)
    at, n = at.reshape(-1).astype(np.int32), len(distinct)
    del keys, distinct
    seen = np.bincount(at, counts, n).astype(np.int64)
    taught = np.bincount(at, counts * teaches, n).astype(np.int64)
    out, start = [(-1, range_, 0, b"", b"", int(seen.sum()), int((seen > 0).sum()), int(taught.sum()))], 0
    for r in rows:
        mine = at[start : start + r["n"]]
        start += r["n"]
        # Only blocks that teach need the deleted counts.
        deleted = _pack(taught[mine].astype("<u4")) if r["part"] == TEACH else b""
        out.append((r["block"], range_, r["n"], _pack(seen[mine].astype("<u8")), deleted, 0, 0, 0))
    return pa.Table.from_batches([batch(_BACK, [*zip(*out)])])


def _estimates(grams: _Grams, counts: list[np.ndarray], n_docs: int, n_tokens: int, vocabulary: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the estimate of each token (order 0: uniform), and the count of each token's history."""
    p = [np.full(len(grams.first), 1 / (vocabulary + 1))]
    history = np.full(len(grams.first), n_tokens, np.int64)
    for k, at in enumerate(grams.at):
        c = counts[k][at]
        if k:
            history = np.empty_like(c)
            history[1:] = counts[k - 1][grams.at[k - 1]][:-1]
            history[grams.first] = n_docs
        # After a history that was never seen an order has no estimate of its own and repeats the one below.
        p.append(np.where(history > 0, c / np.maximum(history, 1), p[-1]))
    return p, history


def _bucket(history: np.ndarray) -> np.ndarray:
    return np.where(history > 0, 1 + np.log2(np.maximum(history, 1)).astype(np.int64), 0)


def _counts(table: pa.Table, order: int, column: str) -> list[np.ndarray]:
    rows = sorted(table.select(["order", "range", "n", column]).to_pylist(), key=lambda r: (r["order"], r["range"]))
    kind = "<u8" if column == "seen" else "<u4"
    return [np.concatenate([_unpack(r[column], kind, r["n"]) for r in rows if r["order"] == k]).astype(np.int64) for k in range(order)]


def learn_weights(bucket: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 60, prior: float = 4.0) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation on buckets, numbers of events and their mean estimates
    (events x estimates). ``prior`` events with the weights of all buckets together steady buckets that have few events."""
    overall = np.full(p.shape[1], 1 / p.shape[1])
    weights = np.tile(overall, (BUCKETS, 1))
    if not len(n):
        return weights
    for _ in range(rounds):
        share = overall * p
        overall = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
    overall = np.maximum(overall, 1e-9) / np.maximum(overall, 1e-9).sum()
    weights = np.tile(overall, (BUCKETS, 1))
    for _ in range(rounds):
        share = weights[bucket] * p
        share = share / share.sum(1, keepdims=True) * n[:, None]
        total = np.zeros_like(weights)
        np.add.at(total, bucket, share)
        total += prior * overall
        weights = total / total.sum(1, keepdims=True)
    return weights


def _quantised(p: np.ndarray, steps: int) -> np.ndarray:
    return np.where(p > 0, 1 + np.round(-steps * np.log2(np.maximum(p, 2.0**-60))).astype(np.int64), 0)


def _histogram(joined, order: int, n_docs: int, n_tokens: int, vocabulary: int, steps: int) -> DataFrame:
    ddl = "bucket long, cell long, n long, sums array<double>"
    schema = pa.schema([("bucket", pa.int64()), ("cell", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        seen, taught = _counts(right, order, "seen"), _counts(right, order, "taught")
        out = []
        for row in left.to_pylist():
            p, history = _estimates(grams := _Grams(row, order), [a - b for a, b in zip(seen, taught)], n_docs, n_tokens, vocabulary)
            bucket = _bucket(history)
            cell = bucket.astype(np.uint64)
            for x in p[1:]:
                with np.errstate(over="ignore"):  # a hash, for high orders and many steps
                    cell = cell * np.uint64(64 * steps) + _quantised(x, steps).astype(np.uint64)
            cell = cell.view(np.int64)
            _, at, n = np.unique(cell, return_inverse=True, return_counts=True)
            one = np.zeros(len(n), np.int64)
            at = at.reshape(-1)
            one[at] = np.arange(len(at))
            sums = np.stack([np.bincount(at, x, len(n)) for x in p], 1)
            out.append(batch(schema, [bucket[one], cell[one], n, sums.tolist()]))
            del grams
        return pa.Table.from_batches(out)

    return joined.applyInArrow(run, ddl)


def _scores(joined, order: int, n_docs: int, n_tokens: int, vocabulary: int, weights: np.ndarray) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        counts, out = _counts(right, order, "seen"), []
        for row in left.to_pylist():
            grams = _Grams(row, order)
            p, history = _estimates(grams, counts, n_docs, n_tokens, vocabulary)
            bucket, mixed = _bucket(history).astype(np.int8), np.zeros(len(history))
            for k in range(order + 1):  # one estimate at a time: a block's arrays are what bounds the memory
                mixed += weights[bucket, k] * p.pop(0)
            c = counts[0][grams.at[0]]
            base = np.log10((c + 1) / (n_tokens + 1 * (vocabulary + 1)))
            add = lambda x: np.add.reduceat(x, grams.starts)
            held = np.full(len(row["docs"]), row["part"] == TEST)
            out.append(batch(schema, [row["docs"], held, row["lengths"], add((c > 0).astype(np.int64)), np.full(len(held), n_tokens), add(base), add(np.log10(mixed))]))
        return pa.Table.from_batches(out)

    return joined.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``."""
    blocks = written(blocks_of(docs, block_tokens), "blocks")
    sums = {r["part"]: r for r in blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("n_words").alias("words"), F.sum(F.size("docs")).alias("docs"), F.count("*").alias("blocks")).collect()}
    get = lambda p, k: sums[p][k] if p in sums else 0
    back, vocabulary = None, 0
    for k in range(order):
        keys = sum(get(p, "tokens" if k else "words") for p in (TRAIN, TEACH, TEST))
        bits = max(1, math.ceil(math.log2(max(1, keys / range_keys))))
        counts = written(_sent(blocks, k, bits).repartition(SPREAD[0] << bits, "range").groupBy("range").applyInArrow(_add_up, _BACK_DDL), f"counts{k + 1}")
        if not k:
            vocabulary = counts.where("block = -1").agg(F.sum("distinct")).first()[0] or 0
        mine = counts.where("block >= 0").select("block", F.lit(k).alias("order"), "range", "n", "seen", "taught")
        back = mine if back is None else back.union(mine)
    n_docs, n_tokens = get(TRAIN, "docs") + get(TEACH, "docs"), get(TRAIN, "tokens") + get(TEACH, "tokens")
    teaching = blocks.where(F.col("part") == TEACH)
    spread = max(1, SPREAD[1] * sum(get(p, "blocks") for p in (TRAIN, TEACH, TEST)))
    meet = lambda x, y: x.repartition(spread, "block").groupBy("block").cogroup(y.repartition(spread, "block").groupBy("block"))
    joined = meet(teaching, back.where(F.octet_length("taught") > 0))
    cells = _histogram(joined, order, get(TRAIN, "docs"), get(TRAIN, "tokens"), vocabulary, steps).groupBy("bucket", "cell")
    cells = written(cells.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(order + 1)]), "cells")
    found = cells.toArrow()  # a few thousand rows: estimates are quantised
    erased(cells)
    n = found.column("n").to_numpy().astype(float)
    means = np.stack([found.column(f"s{i}").to_numpy() for i in range(order + 1)], 1) / n[:, None]
    weights = learn_weights(found.column("bucket").to_numpy(), n, means)
    return _scores(meet(blocks, back), order, n_docs, n_tokens, vocabulary, weights)
