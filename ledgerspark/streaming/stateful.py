"""Keyed state over a stream of usage: blocks, live deltas, and the push gate."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIVE_HOURS_MS = 5 * 3600 * 1000
#: Rows that ``by_time`` sorts in memory; more go to scratch files of the task.
SORTED_ROWS = 1 << 20


def by_time(frames: Iterator[pd.DataFrame], at_once: int = SORTED_ROWS) -> Iterator[tuple[int, int]]:
    """``ts, total`` of all frames in order: a sort of runs of ``at_once`` rows, merged from scratch files if there are several.

    Spark hands a key over in frames of bounded size, whose rows follow no order from one to the next.
    """
    with tempfile.TemporaryFile() as scratch:
        spans, held, rows = [], [], 0

        def run() -> np.ndarray:
            found = np.concatenate(held) if held else np.empty((0, 2), np.int64)
            held.clear()
            return found[np.argsort(found[:, 0], kind="stable")]

        def stored(first: int, count: int) -> Iterator[tuple[int, int]]:
            for k in range(first, first + count, 1 << 12):
                scratch.seek(16 * k)
                yield from map(tuple, np.frombuffer(scratch.read(16 * min(1 << 12, first + count - k)), np.int64).reshape(-1, 2).tolist())

        for frame in frames:
            held.append(frame[["ts", "total"]].to_numpy(np.int64))
            rows += len(frame)
            if rows >= at_once:
                spans.append((sum(n for _, n in spans), rows))
                scratch.write(run().tobytes())
                rows = 0
        yield from heapq.merge(*(stored(*s) for s in spans), map(tuple, run().tolist()), key=lambda r: r[0])


def block_stream(usage: DataFrame, key: str = "session", window_ms: int = FIVE_HOURS_MS) -> DataFrame:
    """The current block per key after each batch: anchor, last time, used.

    A batch's rows of a key are folded in order of ``ts``, however they come in; batches follow one another in time.
    State is three numbers per key.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, last, used = state.get if state.exists else (None, None, 0)
        for ts, total in by_time(frames):
            if anchor is None or ts >= anchor + window_ms:
                anchor, used = ts, 0
            last, used = ts if last is None else max(last, ts), used + total
        if anchor is None:
            return
        state.update((anchor, last, used))
        yield pd.DataFrame({key: [name[0]], "block_start": [anchor], "last_ts": [last], "used": [used], "resets_at": [anchor + window_ms]})

    kind = usage.schema[key].dataType.simpleString()
    return usage.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, block_start long, last_ts long, used long, resets_at long", "anchor long, last long, used long", "update", GroupStateTimeout.NoTimeout)


def live_stream(sessions: DataFrame, key: str = "session") -> DataFrame:
    """Growth of each session's total since it was first seen, and whether its counts changed in this batch.

    The first total seen is the baseline, so a session starts at zero. State is the baseline and the last signature.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, signature = state.get if state.exists else (None, None)
        tokens, latest = None, signature
        for rows in frames:
            for total, sign in rows[["tokens", "signature"]].itertuples(index=False):
                base = int(total) if base is None else base
                if tokens is None or total >= tokens:
                    tokens, latest = int(total), sign
        if tokens is None:
            return
        state.update((base, latest))
        yield pd.DataFrame({key: [name[0]], "delta": [tokens - base], "is_changed": [latest != signature]})

    kind = sessions.schema[key].dataType.simpleString()
    return sessions.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, delta long, is_changed boolean", "base long, signature string", "update", GroupStateTimeout.NoTimeout)


def push_due(enrolled: bool, now_ms: int, last_push_ms: int | None, signature: str, last_signature: str | None, every_ms: int = 45_000) -> bool:
    """Whether a live push goes out: enrolled, long enough since the last one, and something changed."""
    return enrolled and (last_push_ms is None or now_ms - last_push_ms >= every_ms) and signature != last_signature


def sync_due(event: str, now_ms: int, last_ms: int | None) -> bool:
    """Debounce of hook events: a minute at session borders, five after a stop."""
    wait = 300_000 if event == "Stop" else 60_000
    return last_ms is None or now_ms - last_ms >= wait
