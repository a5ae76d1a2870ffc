"""Order-dependent digests of groups, streamed: a task reads its rows sorted and keeps one running hash, never a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_digests(rows: DataFrame, key: str, order: str, text: Column, separator: str) -> DataFrame:
    """``key, order, before, until, n``: SHA-256 of the texts before each row of its group and up to it, joined by the
    separator, and the number of rows before it. ``key`` and ``order`` are bigints or strings; null texts are empty. One
    shuffle by the key and one sort; a group is one task's stream, in constant memory."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    types = dict(rows.dtypes)
    schema = pa.schema([(key, kinds[types[key]]), (order, kinds[types[order]]), ("before", pa.string()), ("until", pa.string()), ("n", pa.int64())])
    joint = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = object(), hashlib.sha256(), 0
        for b in batches:
            out: list[tuple] = []
            for k, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != now:
                    now, state, n = k, hashlib.sha256(), 0
                before = state.hexdigest()
                if n:
                    state.update(joint)
                state.update(t.encode())
                out.append((k, o, before, state.hexdigest(), n))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], type=f.type) for f in schema], schema=schema)

    sorted_rows = rows.select(key, order, F.coalesce(text, F.lit("")).alias("_text")).repartition(key).sortWithinPartitions(key, order, "_text")
    return sorted_rows.mapInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, before string, until string, n bigint")


def group_digests(rows: DataFrame, key: str, order: str, text: Column, separator: str = ",", ends: tuple[str, str] = ("", "")) -> DataFrame:
    """``key, digest, n``: SHA-256 of each group's texts in order, joined, between two ends (a JSON array: ``[`` and ``]``).
    The same digest as of the whole text, which is never built."""
    types = dict(rows.dtypes)
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(key, kinds[types[key]]), ("digest", pa.string()), ("n", pa.int64())])
    first, joint, last = ends[0].encode(), separator.encode(), ends[1].encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, out = None, None, 0, []

        def close() -> None:
            state.update(last)
            out.append((now, state.hexdigest(), n))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or k != now:
                    if state is not None:
                        close()
                    now, state, n = k, hashlib.sha256(first), 0
                if n:
                    state.update(joint)
                state.update(t.encode())
                n += 1
            if out:
                yield made()
                out = []
        if state is not None:
            close()
            yield made()

    sorted_rows = rows.select(key, F.coalesce(text, F.lit("")).alias("_text"), F.col(order).alias("_at")).repartition(key).sortWithinPartitions(key, "_at", "_text").select(key, "_text")
    return sorted_rows.mapInArrow(run, f"`{key}` {types[key]}, digest string, n bigint")
