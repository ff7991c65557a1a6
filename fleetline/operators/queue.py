"""Idempotent event queue with retries and dead letters (Q1-Q13).

No table here is updated in place.  The queue is the fold of two
append-only logs:

* arrivals:    accepted webhooks ``(seq, received_at, sn, event_ts, payload)``
* transitions: writer actions ``(id, at, seq, status, attempts, next_at, reason)``

ordered together by ``(at, src, seq)`` (src 0 = arrival, 1 = transition).
Per queue id: status and attempts come from the last event, ``next_at`` from
the last event that carries one, the payload from the last arrival, and id,
source, spelling and ``created_at`` from the first arrival of the key
``(sn, event_ts)``.  A re-sent event therefore returns to ``queued`` with 0
attempts under its old id, as with the reference's keyed upsert.

The fold is two hash-partitioned aggregations (by key, then by id), each
with a partial map-side step, so a hot device or id never lands on one task
as a sorted group.  The compare-and-set of a claim is resolved when the
transition is produced (``claim`` joins the claim set to the folded state),
never inside the fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions.exprs import backoff_seconds, idiv, normalize_batch, round_s
from fleetline.operators import metrics
from fleetline.operators.state import plain, sn_key

# Fixed values of the reference writer.
MAX_ATTEMPTS = 5
BACKOFF_BASE_S = 5
BACKOFF_CAP_S = 300
DEFAULT_BATCH = 50
TERMINAL = ("done", "dead")
OPEN = ("queued", "processing")

TRANSITION_COLUMNS = ("id", "at", "seq", "status", "attempts", "next_at", "reason")


def _ord(at, src: int, seq):
    return F.struct(F.col(at).alias("at"), F.lit(src).alias("src"), F.col(seq).cast("long").alias("seq"))


def arrivals_from(classified_webhooks: DataFrame) -> DataFrame:
    """Accepted webhooks (code 202) as queue arrivals."""
    return (classified_webhooks.where(F.col("code") == 202)
            .select("seq", "received_at", "sn", "event_ts", "payload"))


def keyed_arrivals(arrivals: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """Q1 core: one row per key ``(sn collated, event_ts)`` with the queue
    id (seq of the first arrival), first spelling, ``created_at`` and the
    last arrival (its time, seq and payload).  ``prev`` (a queue state kept
    with its order columns) contributes the keys and first arrivals already
    known, so a re-sent event keeps its id."""
    rows = arrivals.select(
        sn_key("sn").alias("_k"), "event_ts",
        F.struct(F.col("seq").cast("long").alias("seq"), F.col("sn").alias("sn"),
                 F.col("received_at").alias("at")).alias("_first"),
        F.struct(F.col("seq").cast("long").alias("seq"), F.col("received_at").alias("at"),
                 F.col("payload").alias("payload")).alias("_last"))
    if prev is not None:
        rows = rows.unionByName(prev.select(
            sn_key("sn").alias("_k"), "event_ts",
            F.struct(F.col("id").alias("seq"), F.col("sn").alias("sn"),
                     F.col("created_raw").alias("at")).alias("_first"),
            F.struct(F.col("last_arrival_seq").alias("seq"), F.col("last_arrival_at").alias("at"),
                     F.col("payload").alias("payload")).alias("_last")))
    g = rows.groupBy("_k", "event_ts").agg(
        F.min_by("_first", F.col("_first.seq")).alias("_f"),
        F.max_by("_last", F.col("_last.seq")).alias("_l"))
    return g.select(
        F.col("_f.seq").alias("id"),
        F.lit("acs").alias("source"),
        plain(F.col("_f.sn")).alias("sn"),
        "event_ts",
        F.col("_f.at").alias("created_raw"),
        F.col("_l.at").alias("last_arrival_at"),
        F.col("_l.seq").alias("last_arrival_seq"),
        F.col("_l.payload").alias("payload"),
    )


STATE_COLUMNS = ("created_raw", "last_arrival_at", "last_arrival_seq", "next_raw", "last_order")


def fold(arrivals: DataFrame, transitions: DataFrame | None = None,
         keep_order_columns: bool = False, prev: DataFrame | None = None) -> DataFrame:
    """Current queue table from the two logs (Q1 with Q3-Q7 applied).

    ``prev``: an earlier result of ``fold(..., keep_order_columns=True)``;
    the logs then hold only what was appended after it, and the result
    equals the fold of the complete logs (incremental compaction)."""
    k = keyed_arrivals(arrivals, prev)
    a_struct = F.struct("source", "sn", "event_ts", "payload", "created_raw",
                        "last_arrival_at", "last_arrival_seq")
    a = k.select(
        "id", _ord("last_arrival_at", 0, "last_arrival_seq").alias("_o"),
        F.lit("queued").alias("status"), F.lit(0).alias("attempts"),
        F.col("last_arrival_at").alias("next_at"), a_struct.alias("_a"))
    none_a = F.lit(None).cast(a.schema["_a"].dataType).alias("_a")
    parts = a
    if transitions is not None:
        t = transitions.select(
            "id", _ord("at", 1, "seq").alias("_o"), "status",
            F.col("attempts").cast("int").alias("attempts"), "next_at", none_a)
        parts = parts.unionByName(t)
    if prev is not None:
        p = prev.select("id", F.col("last_order").alias("_o"), "status",
                        F.col("attempts").cast("int").alias("attempts"),
                        F.col("next_raw").alias("next_at"), none_a)
        parts = parts.unionByName(p)
    g = parts.groupBy("id").agg(
        F.max_by(F.struct("status", "attempts"), "_o").alias("_s"),
        F.max_by("next_at", F.when(F.col("next_at").isNotNull(), F.col("_o"))).alias("next_raw"),
        F.max_by("_a", F.when(F.col("_a").isNotNull(), F.col("_o"))).alias("_a"),
        F.max("_o").alias("_last"))
    g = g.where(F.col("_a").isNotNull())  # transitions of unknown ids
    out = g.select(
        "id", F.col("_a.source").alias("source"), F.col("_a.sn").alias("sn"),
        F.col("_a.event_ts").alias("event_ts"), F.col("_a.payload").alias("payload"),
        F.col("_s.status").alias("status"), F.col("_s.attempts").alias("attempts"),
        round_s(F.col("next_raw")).alias("next_at"),
        round_s(F.col("_a.created_raw")).alias("created_at"),
        round_s(F.col("_last.at")).alias("updated_at"),
        F.col("_a.created_raw").alias("created_raw"),
        F.col("_a.last_arrival_at").alias("last_arrival_at"),
        F.col("_a.last_arrival_seq").alias("last_arrival_seq"),
        "next_raw", F.col("_last").alias("last_order"))
    return out if keep_order_columns else out.drop(*STATE_COLUMNS)


def enqueue(arrivals: DataFrame, prev_transitions: DataFrame | None = None) -> DataFrame:
    """Q1: idempotent enqueue of accepted webhooks (optionally on top of the
    transitions written so far)."""
    return fold(arrivals, prev_transitions)


def ready(queue: DataFrame, as_of, limit=DEFAULT_BATCH) -> DataFrame:
    """Q2: ``status='queued' AND next_at <= as_of ORDER BY id LIMIT n``;
    ``n <= 0`` or invalid -> 50.  A top-k: each partition keeps its n
    smallest ids, the driver merges at most n per partition."""
    n = normalize_batch(limit)
    return (queue.where((F.col("status") == "queued") & (F.col("next_at") <= _ts(as_of)))
            .orderBy("id").limit(n))


def _ts(as_of):
    return as_of if isinstance(as_of, F.Column) else F.lit(as_of).cast("timestamp_ntz")


def claim(queue: DataFrame, claims: DataFrame, as_of, seq: int = 0) -> DataFrame:
    """Q3: compare-and-set ``queued -> processing`` with attempts+1.  Claims
    of ids no longer queued are skipped; duplicate claims collapse.  The
    join lets adaptive execution broadcast the claim set when its measured
    size is small (it is bounded by the batch size in ``drain``)."""
    c = claims.select("id").distinct()
    j = c.join(queue.select("id", "status", "attempts"), "id")
    return j.select(
        "id", F.col("status").alias("prev_status"),
        (F.col("status") == "queued").alias("claimed"),
        _ts(as_of).alias("at"), F.lit(seq).cast("long").alias("seq"),
        F.lit("processing").alias("status"),
        (F.col("attempts") + 1).cast("int").alias("attempts"),
        F.lit(None).cast("timestamp_ntz").alias("next_at"),
        F.lit(None).cast("string").alias("reason"),
    ).where("claimed").select(*TRANSITION_COLUMNS)


def complete(claimed: DataFrame, as_of, seq: int = 1) -> DataFrame:
    """Q4: ``done`` for the given ids, unconditionally; attempts unchanged
    (``claimed`` carries the attempts the claim wrote)."""
    return claimed.select(
        "id", _ts(as_of).alias("at"), F.lit(seq).cast("long").alias("seq"),
        F.lit("done").alias("status"), F.col("attempts").cast("int"),
        F.lit(None).cast("timestamp_ntz").alias("next_at"),
        F.lit(None).cast("string").alias("reason"))


def failure_state(new_attempts, at, policy: str = "writer", max_attempts: int = MAX_ATTEMPTS,
                  base: int = BACKOFF_BASE_S):
    """(status, next_at) after a failure with ``new_attempts``.

    writer: ``>= max`` -> dead (next_at unchanged = NULL here); else queued at
            ``at + min(base * 2^n, 300 s)``  (1 -> 10 s, 4 -> 80 s).
    queue:  ``>= max`` -> dead; else queued at ``at + base * 2^(n-1)``,
            uncapped (1 -> base, 2 -> 2 base)."""
    n = F.col(new_attempts) if isinstance(new_attempts, str) else new_attempts
    if policy == "writer":
        delay = backoff_seconds(n, base, BACKOFF_CAP_S)
    elif policy == "queue":
        delay = backoff_seconds(n, base, None, offset=1)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    dead = n >= max_attempts
    status = F.when(dead, F.lit("dead")).otherwise(F.lit("queued"))
    at_c = F.col(at) if isinstance(at, str) else at
    next_at = F.when(~dead, at_c + F.make_dt_interval(secs=delay))
    return status, next_at


def fail(queue: DataFrame, failures: DataFrame, as_of, policy: str = "writer",
         max_attempts: int = MAX_ATTEMPTS, base: int = BACKOFF_BASE_S, seq: int = 1) -> DataFrame:
    """Q5 (writer policy: new attempts = the attempts the claim wrote) and Q7
    (queue policy: increments attempts itself).  ``failures``: ``id, reason``."""
    f = failures.select("id", "reason").dropDuplicates(["id"])
    j = f.join(queue.select("id", "attempts"), "id")
    n = F.col("attempts") if policy == "writer" else F.col("attempts") + 1
    j = j.withColumn("_n", n.cast("int")).withColumn("at", _ts(as_of))
    status, next_at = failure_state("_n", "at", policy, max_attempts, base)
    return j.select("id", "at", F.lit(seq).cast("long").alias("seq"), status.alias("status"),
                    F.col("_n").alias("attempts"), next_at.alias("next_at"), "reason")


def drain(queue: DataFrame, as_of, limit=DEFAULT_BATCH) -> DataFrame:
    """Q8: one writer tick: ready batch -> claim -> process -> done, as the
    transitions it writes (two per processed event, no per-row loop).

    The batch is selected from the same queue snapshot in the same job, so
    every claim's compare-and-set succeeds: both transitions are produced
    from the ready rows in one pass (``claim`` is for claim sets that come
    from elsewhere)."""
    batch = ready(queue, as_of, limit).select("id", "attempts")
    n = (F.col("attempts") + 1).cast("int")
    steps = F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit("processing").alias("status")),
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit("done").alias("status"))))
    t = batch.select("id", n.alias("attempts"), steps.alias("_s"))
    return t.select(
        "id", _ts(as_of).alias("at"), F.col("_s.seq").alias("seq"), F.col("_s.status").alias("status"),
        "attempts", F.lit(None).cast("timestamp_ntz").alias("next_at"),
        F.lit(None).cast("string").alias("reason"))


def depth(queue: DataFrame, as_of) -> DataFrame:
    """Q9: events per status and how many queued ones are due."""
    due = (F.col("status") == "queued") & (F.col("next_at") <= _ts(as_of))
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("events"),
                                       F.count_if(due).alias("ready"))


def lag(queue: DataFrame, as_of) -> DataFrame:
    """Q10: age of the oldest unfinished event (one row)."""
    o = queue.where(F.col("status").isin(*OPEN))
    a = o.agg(F.count(F.lit(1)).alias("open_events"), F.min("created_at").alias("oldest_created_at"))
    secs = F.unix_seconds(_ts(as_of).cast("timestamp")) - F.unix_seconds(
        F.col("oldest_created_at").cast("timestamp"))
    return a.select("open_events", "oldest_created_at", secs.alias("lag_seconds"))


def backlog(arrivals: DataFrame, transitions: DataFrame, step: str = "1 hour",
            split_seconds: int = 86_400) -> DataFrame:
    """Q11: open events over time.  Per queue id the open/closed flag is
    replayed over its events in ``(at, src, seq)`` order; each change is
    +1/-1 at its time, summed per step bucket, then a running sum over the
    bucket table: a row for every step between the first and the last change.

    The replay uses the time-bucketed ``neighbors`` per queue id (a long
    key, so the windowed rows keep their partitioning through the
    per-bucket carry join): an id re-sent a third of all times is spread
    over many tasks.  Arrivals find their id through one join with the
    one-row-per-key table (adaptive skew-join splits a hot key)."""
    from fleetline.operators.series import neighbors

    keys = keyed_arrivals(arrivals).select("id", sn_key("sn").alias("_kk"), F.col("event_ts").alias("_ke"))
    a = arrivals.select(sn_key("sn").alias("_k"), "event_ts", "received_at", "seq")
    a = a.join(keys, (a["_k"] == keys["_kk"]) & (a["event_ts"] == keys["_ke"])).select(
        "id", F.col("received_at").alias("at"), F.lit(0).alias("src"),
        F.col("seq").cast("long").alias("seq"), F.lit(True).alias("is_open"))
    t = transitions.select(
        "id", "at", F.lit(1).alias("src"), F.col("seq").cast("long").alias("seq"),
        F.col("status").isin(*OPEN).alias("is_open"))
    e = neighbors(a.unionByName(t), ["id"], "at", ["is_open"],
                  tiebreak=["src", "seq"], split_seconds=split_seconds)
    prev = F.coalesce(F.col("prev_is_open"), F.lit(False))
    d = e.select("at", (F.col("is_open").cast("int") - prev.cast("int")).alias("delta"))
    d = d.where(F.col("delta") != 0)
    us, day = metrics._micros(step), 86_400_000_000
    b = d.groupBy(((idiv(F.unix_micros(F.col("at").cast("timestamp")), us) + 1) * F.lit(us)).cast("long").alias("_e")).agg(
        F.sum(F.when(F.col("delta") > 0, 1).otherwise(0)).alias("opened"),
        F.sum(F.when(F.col("delta") < 0, 1).otherwise(0)).alias("closed"))
    # every step between the first and the last change, made day by day (or step by step, if longer)
    wide = max(us, day // us * us)
    days = b.agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi")).where("_lo is not null").select(
        "_lo", "_hi", F.explode(F.sequence(idiv("_lo", wide), idiv("_hi", wide))).alias("_day"))
    steps = days.repartition("_day").select("_day", "_lo", "_hi", F.explode(F.sequence(
        F.col("_day") * wide, F.col("_day") * wide + wide - us, F.lit(us).cast("long"))).alias("_e"))
    quiet = steps.where("_e between _lo and _hi").select("_e", F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("closed"))
    b = b.unionByName(quiet).groupBy("_e").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    # running sum: within a day, plus what the days before carry (one row per day)
    b = b.withColumn("_day", idiv("_e", wide))
    within = Window.partitionBy("_day").orderBy("_e").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy("_day").agg(F.sum(F.col("opened") - F.col("closed")).alias("_n")).select(
        "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    return b.withColumn("_sum", F.sum(F.col("opened") - F.col("closed")).over(within)).join(carry, "_day").select(
        F.timestamp_micros("_e").cast("timestamp_ntz").alias("bucket_end"), "opened", "closed",
        (F.col("_sum") + F.col("_carry")).alias("open_events"))


def purge(queue: DataFrame, as_of, days: int) -> DataFrame:
    """Q12: ``done`` rows last updated more than ``days`` before ``as_of``
    are archived, the rest stay live.  Returns the queue with an
    ``action`` column; write ``archive`` rows to the archive partitions and
    the ``keep`` rows as the new live set."""
    old = (F.col("status") == "done") & (
        F.col("updated_at") < _ts(as_of) - F.make_dt_interval(days=F.lit(days)))
    return queue.withColumn("action", F.when(old, F.lit("archive")).otherwise(F.lit("keep")))


def writer_counters(transitions: DataFrame) -> DataFrame:
    """M8-M10 over a transitions log: processed (done), failed by reason
    (a dead event also counts as failed), dead."""
    t = transitions
    done = t.where(F.col("status") == "done").select(
        F.lit("writer_events_processed_total").alias("metric"), F.lit("").alias("label"))
    failed = t.where(F.col("reason").isNotNull()).select(
        F.lit("writer_events_failed_total").alias("metric"), F.col("reason").alias("label"))
    dead = t.where(F.col("status") == "dead").select(
        F.lit("writer_events_dead_total").alias("metric"), F.lit("").alias("label"))
    return (done.unionByName(failed).unionByName(dead)
            .groupBy("metric", "label").agg(F.count(F.lit(1)).alias("value")))


def writer_runs(ticks: DataFrame) -> DataFrame:
    """M7: writer ticks (one row per tick in the tick log, empty ticks
    included) and the events they drained."""
    return ticks.agg(F.count(F.lit(1)).alias("writer_runs_total"), F.coalesce(F.sum("drained"), F.lit(0)).alias("drained_total"))
