"""Replay of a session's visible surface: appends, range replacements, headers and step boundaries.

The surface at an event depends on all events before it, and a replacement names a range of it, so it is sequential
state: one Arrow group a session, ordered by its durable numbers. A session is the unit of one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

INPUT = "session_id string, seq long, kind string, op string, start long, end long, sources array<long>, turn long, step long"
OUTPUT = "session_id string, output_seq long, context array<long>, header_seq long, turn long, step long, blocked string"

SURFACE = frozenset({"user/message", "assistant/message", "tool/result", "system/message"})
KNOWN = SURFACE | {"request/header", "request/context", "turn/start", "turn/end", "step/start", "step/end", "session/start", "tool/call", "usage"}


class _Session:
    """State of one session; ``blocked`` is the first reason after which nothing can be reconstructed."""

    def __init__(self) -> None:
        self.surface: list[int] = []
        self.header = self.turn = self.step = self.blocked = None

    def block(self, reason: str) -> None:
        self.blocked = self.blocked or reason

    def show(self, seq: int, op, start, end, sources) -> None:
        if op == "append":
            self.surface.append(seq)
            return
        if op != "replace":
            return self.block("surface_operation_missing")
        place = {s: i for i, s in enumerate(self.surface)}
        a, b = place.get(start, -1), place.get(end, -1)
        if a < 0 or b < a:
            return self.block("surface_replace_invalid")
        if sources is None or not set(self.surface[a : b + 1]) <= set(sources):
            return self.block("surface_sources_incomplete")
        self.surface[a : b + 1] = [seq]


def _whole(x):
    return None if x is None or x != x else int(x)


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    state, out, expected = _Session(), [], 0
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        if r.seq != expected:
            state.block("sequence_gap_or_duplicate" if expected else "sequence_does_not_start_at_zero")
        expected = r.seq + 1
        turn, step = _whole(r.turn), _whole(r.step)
        if r.kind not in KNOWN:
            if r.op != "ignorable":
                state.block("unknown_required_event")
            continue
        if r.kind == "request/header":
            state.header = r.seq
        elif r.kind == "turn/start":
            state.turn, state.step = turn, None
        elif r.kind == "step/start":
            state.turn, state.step = turn, step
        elif r.kind == "assistant/message":
            reason = state.blocked or (None if state.header is not None else "header_missing")
            out.append((r.session_id, r.seq, [*state.surface], state.header, state.turn, state.step, reason))
        elif r.kind == "step/end":
            if (turn, step) != (state.turn, state.step):
                state.block("step_boundary_mismatch")
            state.step = None
        elif r.kind == "turn/end":
            state.turn = state.step = None
        if r.kind in SURFACE:
            state.show(r.seq, r.op, _whole(r.start), _whole(r.end), r.sources)
    made = pd.DataFrame(out, columns=["session_id", "output_seq", "context", "header_seq", "turn", "step", "blocked"])
    return made.astype({c: "Int64" for c in ("header_seq", "turn", "step")})


def request_epochs(events: DataFrame) -> DataFrame:
    """Every assistant output with the surface that its request saw, its header, turn and step; ``blocked`` says why it
    can't be trusted (null: it can)."""
    return events.groupBy("session_id").applyInPandas(_replay, OUTPUT)
