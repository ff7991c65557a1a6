"""Retries by keyed streaming state with timers (Q3-Q7 without a fold).

The stream has two kinds of rows per queue id: ``arrival`` (the event is queued
and due at once) and the workers' ``result`` (``reason`` null: processed, else
failed).  Each id keeps five numbers of state.  An id that waits has a timer at
its ``next_at``; when it fires, the claim is written, so a retry costs work for
its own id only, however many others the queue holds.  Output are the writer's
transitions, which ``queue.fold`` turns into the queue table.

Timers run on event time: they fire when the watermark passes ``next_at``, and
rows of kind ``clock`` (the ticks of the writer loop, any id) move it while
nothing arrives.  A claim carries the time at which it was due, not the time at
which the timer happened to fire, so results do not depend on how the stream is
cut into micro-batches.  ``on_time="processing"`` fires by the machine's clock
instead, for live runs without clock rows; the written times are the same.

Rows of one id must come in order of ``(at, seq)`` across micro-batches, as its
arrivals and results do; within a micro-batch they are sorted.  A result for an
id that is not processing (late, or never claimed) changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetline.operators.queue import BACKOFF_BASE_S, BACKOFF_CAP_S, MAX_ATTEMPTS

EVENTS = "id long, kind string, at timestamp_ntz, seq long, reason string"
OUTPUT = "id long, at timestamp_ntz, seq long, status string, attempts int, next_at timestamp_ntz, reason string"
KEPT = "ids binary"  # rows of ``KEPT_ROW``, one per id
KEPT_ROW = np.dtype([("id", "<i8"), ("status", "<i1"), ("attempts", "<i4"), ("next_us", "<i8"), ("at_us", "<i8"), ("written", "<i8")])
STATUSES = ("", "queued", "processing", "done", "dead")
SPAN = 1 << 10
NEW = ("", 0, 0, 0, 0)
SECOND = 1_000_000
NAT = np.datetime64("NaT").astype(np.int64)
LAST = 2**63 - 1


def steps(kept: tuple, rows: list[tuple[str, int, str | None]], upto: int | None) -> tuple[tuple, list[tuple]]:
    """State and transitions of one id after its ``rows`` (kind, at, reason) in
    order, and after the timers due by ``upto`` (all times in microseconds)."""
    status, attempts, due, at, written = kept
    out: list[tuple] = []

    def write(when: int, new: str, next_us: int | None = None, reason: str | None = None) -> None:
        nonlocal status, at, written
        status, at = new, when
        out.append((when, written, new, attempts, next_us, reason))
        written += 1

    def fire(limit: int) -> None:
        nonlocal attempts
        if status == "queued" and due <= limit:
            attempts += 1
            write(due, "processing")

    for kind, when, reason in rows:
        if kind == "arrival":
            fire(when - 1)
            status, attempts, due, at = "queued", 0, when, when
        fire(when)
        if kind == "result" and status == "processing":
            if reason is None:
                write(when, "done")
            elif attempts >= MAX_ATTEMPTS:
                write(when, "dead", None, reason)
            else:
                due = when + min(BACKOFF_BASE_S << attempts, BACKOFF_CAP_S) * SECOND
                write(when, "queued", due, reason)
    if upto is not None:
        fire(upto)
    return (status, attempts, due, at, written), out


def packed(kept: dict[int, tuple]) -> bytes:
    return np.array([(i, STATUSES.index(k[0]), *k[1:]) for i, k in kept.items()], KEPT_ROW).tobytes()


def unpacked(ids: bytes) -> dict[int, tuple]:
    return {i: (STATUSES[status], *rest) for i, status, *rest in np.frombuffer(ids, KEPT_ROW).tolist()}


def span_steps(kept: dict[int, tuple], rows: list[tuple], now: int) -> list[tuple]:
    """Transitions of the ids of a span, ``kept`` brought up to date: ``rows`` (id,
    kind, at, reason) in order, and the timers that ``now`` has reached for ids
    with rows and passed for the others, as timers of their own would fire."""
    out: list[tuple] = []
    for i, own in groupby(rows, itemgetter(0)):
        told = [row[1:] for row in own if row[1] != "clock"]
        if told or i in kept:  # clock rows only move the watermark
            kept[i], done = steps(kept.get(i, NEW), told, now)
            out += [(i, *d) for d in done]
    for i, k in kept.items():
        if k[0] == "queued" and -(-k[2] // 1000) * 1000 < now:
            kept[i], done = steps(k, [], now)
            out += [(i, *d) for d in done]
    return out


def _frame(key: int | list[int], out: list[tuple]) -> pd.DataFrame:
    at, seq, status, attempts, next_at, reason = zip(*out, strict=True)
    return pd.DataFrame({"id": key, "at": np.array(at, "datetime64[us]"), "seq": np.array(seq, np.int64), "status": status,
                         "attempts": np.array(attempts, np.int32),
                         "next_at": np.array([NAT if x is None else x for x in next_at], np.int64).view("datetime64[us]"), "reason": reason})


def _ordered(frames: Iterator[pd.DataFrame], of: str | None = None) -> list[tuple]:
    """Rows (kind, at, reason) in order of ``(at, seq)``, a missing seq last; with
    a column ``of``, rows (its value, kind, at, reason) in order of it first.  An
    id has few rows: plain lists, as a frame's own sort costs more than all else
    that is done for the id."""
    rows: list[tuple] = []
    for f in frames:
        first = f[of].tolist() if of else [0] * len(f)
        rows += zip(first, f["at_us"].tolist(), f["seq"].tolist(), f["kind"].tolist(), f["reason"].tolist(), strict=True)
    rows.sort(key=lambda r: (r[0], r[1], r[2] != r[2], r[2]))
    told = [(i, k, int(a), r if isinstance(r, str) else None) for i, a, _, k, r in rows]
    return told if of else [t[1:] for t in told]


def retry_transitions(events: DataFrame, delay: str = "0 seconds", on_time: str = "event") -> DataFrame:
    """Transitions of a stream of ``EVENTS`` rows; ``delay`` is how much later
    than its time a row may come."""
    by_event = on_time == "event"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = unpacked(state.get[0]) if state.exists else {}
        rows = [] if state.hasTimedOut else _ordered(frames, "id")
        now = (state.getCurrentWatermarkMs() if by_event else state.getCurrentProcessingTimeMs()) * 1000
        out = span_steps(kept, rows, now)
        if not kept:
            return
        state.update((packed(kept),))
        due = min((k[2] for k in kept.values() if k[0] == "queued"), default=None)
        if due is not None:
            ms = -(-due // 1000)
            if by_event:
                state.setTimeoutTimestamp(max(ms, now // 1000, 1))
            else:
                state.setTimeoutDuration(max(1, ms - now // 1000))
        if out:
            yield _frame([o[0] for o in out], [o[1:] for o in out])

    at = F.col("at").cast("timestamp")
    e = events.select(F.coalesce("id", F.lit(-1)).cast("long").alias("id"), "kind", at.alias("_at"), F.unix_micros(at).alias("at_us"),
                      F.coalesce(F.col("seq").cast("long"), F.lit(LAST)).alias("seq"), "reason")  # a missing seq is the last one
    e = e.withColumn("span", F.shiftright("id", SPAN.bit_length() - 1))
    if by_event:
        e = e.withWatermark("_at", delay)
    timeout = GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout
    return e.groupBy("span").applyInPandasWithState(run, OUTPUT, KEPT, "append", timeout)


def retry_stream(events: DataFrame, sink: str, checkpoint: str, delay: str = "0 seconds", on_time: str = "event",
                 available_now: bool = True, interval: str = "1 second"):
    """The retry loop as a stream into Parquet under ``sink``."""
    w = (retry_transitions(events, delay, on_time).writeStream.outputMode("append").format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
