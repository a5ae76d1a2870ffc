"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into blocks, say 6. Fingerprints that differ in at most 4 bits differ in at most 4
blocks, so they agree in at least 2: joining on every choice of 2 blocks (15 keys of about 21 bits) loses no pair, and
each candidate's Hamming distance is then computed. A pair is counted for the first key it shares only. More blocks make
more but longer keys: 7 give 35 keys of about 27 bits, 8 give 70 of 32. The number of distinct fingerprints decides
(:func:`blocks_for`), so that chance candidates don't outgrow the keys; the links are the same for any number.
Copies are one row throughout: only distinct fingerprints are joined, and each carries the number of its documents.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows are documents of
their own in ``n_near``; a null ``doc_id`` is fingerprinted and linked but never names a component (a component of
null ids alone has a null id); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import batch, release, texts_of, written

SHINGLE = 4
SEED = 42
MAX_BITS = 4


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is one if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in texts_of(batches):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield batch(schema, [b.column("doc_id"), fps])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(bits: int = MAX_BITS, blocks: int = 6) -> list[int]:
    """One mask (signed) for every choice of ``blocks - bits`` blocks."""
    if blocks <= bits:
        raise ValueError("more blocks than differing bits are needed")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(each, blocks - bits)]


def blocks_for(n: int, bits: int = MAX_BITS) -> int:
    """The number of blocks with the least work for ``n`` distinct fingerprints: keys, and chance candidates for each."""
    work = lambda b: math.comb(b, bits) * n * (1 + n / 2 ** (64 * (b - bits) / b))
    return min(range(bits + 1, bits + 13), key=work)


def links(fps: DataFrame, bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """``a, b, n_a, n_b`` for every pair a < b of the distinct fingerprints ``fp, n`` at ``bits`` or fewer bits."""
    all_masks = masks(bits, blocks or blocks_for(fps.count(), bits))
    keyed = fps.select("fp", "n", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in all_masks])).alias("c", "key"))
    left = keyed.select("c", "key", F.col("fp").alias("a"), F.col("n").alias("n_a"))
    right = keyed.select("c", "key", F.col("fp").alias("b"), F.col("n").alias("n_b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(all_masks)])
    near = left.join(right, ["c", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= bits))
    return near.where(first == F.col("c")).select("a", "b", "n_a", "n_b")


def _groups(rows: DataFrame, bits: int, blocks: int | None) -> DataFrame:
    """``fp, n, first, others, part`` of the distinct fingerprints of a written table of ``doc_id, fp``: documents,
    smallest id, documents with linked fingerprints, and the component's smallest fingerprint."""
    fps = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "distinct")
    pairs = written(links(fps, bits, blocks), "links")
    near = pairs.select("a", "n_b").union(pairs.select("b", "n_a")).toDF("fp", "others").groupBy("fp").agg(F.sum("others").alias("others"))
    parts = connected_components(pairs.select("a", "b")).toDF("fp", "part")
    known = fps.join(near, "fp", "left").join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    return written(known.withColumn("others", F.coalesce("others", F.lit(0))), "known")


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, n_near, component_id`` for every row of ``docs``."""
    rows = written(fingerprints(docs), "fingerprints")
    known = _groups(rows, bits, blocks)
    names = known.groupBy("part").agg(F.min("first").alias("component_id"))
    known = known.join(names, "part").select("fp", (F.col("n") - 1 + F.col("others")).alias("n_near"), "component_id")
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def _fingerprint_udf():
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        fps = np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64)
        release()
        return pd.Series(fps)

    return run


def keep_one(docs: DataFrame, bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, of which each component of near duplicates keeps the one with the
    smallest ``doc_id`` (null last, then the smallest fingerprint; of rows equal in both, one)."""
    # The rows with their fingerprints and numbers are stored once; texts are shuffled once, by the number.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    stored = written(docs.select(whole, F.col("doc_id").alias("id"), _fingerprint_udf()("text").alias("fp"), F.monotonically_increasing_id().alias("row")), "fingerprints")
    known = _groups(stored.select(F.col("id").alias("doc_id"), "fp"), bits, blocks)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "row")
    first = stored.groupBy("fp").agg(F.min(order).alias("first"))  # one row a fingerprint before the join
    chosen = first.join(known.select("fp", "part"), "fp").groupBy("part").agg(F.min("first")["row"].alias("row"))
    # One way to join at every size: the chosen rows grow with the table.
    return stored.join(written(chosen.select("row"), "chosen").hint("merge"), "row", "left_semi").select("doc.*")
