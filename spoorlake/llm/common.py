"""Shared helpers: durable intermediate tables, Arrow row blocks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..operators.durable import erased, shared_dir, written

__all__ = ["batch", "erased", "partition_id", "release", "shared_dir", "table", "texts_of", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def texts_of(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch in slices of at most about 4 MB of text, with its texts (null: empty)."""
    for b in batches:
        n, start = b.num_rows, 0
        sizes = b.column(column).nbytes
        step = max(1, int(n * 4e6 / max(sizes, 1)))
        while start < n:
            part = b.slice(start, step)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start += step


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and what they keep adds up over the
    stages of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
