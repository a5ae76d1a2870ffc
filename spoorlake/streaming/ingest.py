"""Streaming ingestion of raw envelopes: idempotency, contiguity, and publication to Parquet.

Watermarks bound the state of the duplicate filter; they are an addition of this library, not event-time windows: late
data is an integrity problem here, never dropped silently (conflicts and gaps go to a quarantine table).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENVELOPE = "session_id string, seq long, event_id string, captured_at timestamp, payload string"


def read(spark: SparkSession, path: str, schema: str = ENVELOPE, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines that land in a folder; ``files_per_trigger`` is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the idempotency key (session and event id, else the payload's digest) and the payload digest."""
    digest = F.sha2(F.coalesce("payload", F.lit("")), 256)
    return rows.withColumns({"payload_sha256": digest, "key": F.concat_ws(":", F.coalesce("session_id", F.lit("")), F.coalesce("event_id", digest))})


def drop_repeats(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row a key within the watermark."""
    return keyed(rows).withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["key"])


_OUT = "session_id string, seq long, event_id string, sequence long, verdict string"
_STATE = "next long, appended long, broken boolean, digests map<string, string>"


def _admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Verdicts of a session's rows, in order: ``new``, ``duplicate`` (same digest), ``conflict`` (another digest) or
    ``gap``; conflicts and gaps are terminal. The digests of accepted numbers are the session's state."""
    next_, appended, broken, digests = state.get if state.exists else (0, 0, False, {})
    digests = dict(digests)
    rows = pd.concat([*frames]).sort_values(["seq", "event_id"], kind="stable")
    out: list[tuple[Any, ...]] = []
    for r in rows.itertuples(index=False):
        known = digests.get(str(r.seq))
        if broken:
            verdict = "quarantined"
        elif known is not None:
            verdict = "duplicate" if known == r.payload_sha256 else "conflict"
            broken = verdict == "conflict"
        elif r.seq == next_:
            verdict, next_ = "new", next_ + 1
            digests[str(r.seq)] = r.payload_sha256
        else:
            verdict, broken = "gap", True
        out.append((key[0], r.seq, r.event_id, appended if verdict == "new" else None, verdict))
        appended += verdict == "new"
    state.update((next_, appended, broken, digests))
    made = pd.DataFrame(out, columns=["session_id", "seq", "event_id", "sequence", "verdict"])
    yield made.astype({"seq": "Int64", "sequence": "Int64"})


def admit(rows: DataFrame) -> DataFrame:
    """Contiguity per session, starting at 0: ``session_id, seq, event_id, sequence, verdict``."""
    return keyed(rows).groupBy("session_id").applyInPandasWithState(_admit, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def publish(rows: DataFrame, good: str, quarantine: str, checkpoint: str):
    """Writes admitted rows and the rest to two tables per micro-batch; returns the query. A batch that is repeated
    after a failure overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("verdict = 'new'").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("verdict <> 'new'").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
