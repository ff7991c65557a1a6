"""Latest state and history per device (H1-H4).

Keys compare like the reference collation (case- and accent-insensitive,
trailing spaces significant): ``sn COLLATE UNICODE_CI_AI``.  The stored
``sn`` keeps its original spelling and binary collation.

All per-key reductions are ``groupBy().agg(min_by/max_by)``: Spark runs them
as partial (map-side) plus final aggregation (sort-based, since the state
holds structs), so a device that sends a
third of all heartbeats costs one partial row per input partition before the
shuffle instead of one giant sorted group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions.exprs import round_ms, round_s

STATUS_FIELDS = ("last_seen", "wan_ip", "sw_version", "cpu_pct", "mem_pct")


def sn_key(c="sn"):
    """Comparison key of a device serial number."""
    return F.collate(F.col(c) if isinstance(c, str) else c, "UNICODE_CI_AI")


def plain(c):
    """Back to binary collation before output (a collated type would
    otherwise survive into Parquet and into comparisons)."""
    return F.collate(F.col(c) if isinstance(c, str) else c, "UTF8_BINARY")


def status_rows(classified: DataFrame) -> DataFrame:
    """Heartbeats that reach the tables: decoded, sn present, constraints
    ok, i.e. provisional code 202.  (History collisions do not stop the
    status upsert.)"""
    return (classified.where(F.col("code") == 202)
            .select("seq", "received_at", "sn", *STATUS_FIELDS))


def _fold(rows: DataFrame) -> DataFrame:
    """rows: seq, first_seq, received_at, sn, fields -> one row per key."""
    last = F.struct(*STATUS_FIELDS, "received_at", "seq")
    g = rows.groupBy(sn_key("sn").alias("_k")).agg(
        F.min_by("sn", "first_seq").alias("sn"),
        F.min("first_seq").alias("first_seq"),
        F.max_by(last, "seq").alias("_l"))
    return g.select(
        plain("sn").alias("sn"),
        F.col("_l.last_seen").alias("last_seen"),
        F.col("_l.wan_ip").alias("wan_ip"),
        F.col("_l.sw_version").alias("sw_version"),
        F.col("_l.cpu_pct").cast("tinyint").alias("cpu_pct"),
        F.col("_l.mem_pct").cast("tinyint").alias("mem_pct"),
        round_s(F.col("_l.received_at")).alias("updated_at"),
        F.col("_l.received_at").alias("received_at"),
        F.col("_l.seq").alias("seq"),
        "first_seq",
    )


def latest_state(classified: DataFrame, keep_order_columns: bool = False) -> DataFrame:
    """H1: one row per device.  The last arrival (largest ``seq``) wins as a
    whole row, NULLs included; the stored spelling is the first arrival's.
    ``keep_order_columns`` keeps ``received_at, seq, first_seq`` so the
    result can later be merged with new arrivals (H4)."""
    rows = status_rows(classified).withColumn("first_seq", F.col("seq"))
    out = _fold(rows)
    if not keep_order_columns:
        out = out.drop("received_at", "seq", "first_seq")
    return out


def merge_state(prev: DataFrame, classified: DataFrame, keep_order_columns: bool = True) -> DataFrame:
    """H4: prior state (with ``received_at, seq, first_seq``) merged with a
    new batch of classified heartbeats; equal to ``latest_state`` over all
    arrivals.  Re-running with the same batch changes nothing."""
    old = prev.select(
        "seq", "first_seq", "received_at", "sn",
        *[F.col(f).cast("long") if f in ("cpu_pct", "mem_pct") else F.col(f) for f in STATUS_FIELDS])
    new = status_rows(classified).withColumn("first_seq", F.col("seq"))
    new = new.select(*old.columns)
    out = _fold(old.unionByName(new))
    if not keep_order_columns:
        out = out.drop("received_at", "seq", "first_seq")
    return out


def merge_states(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Two states kept with their order columns as one: the result of
    ``latest_state`` over the arrivals of both."""
    cols = ["seq", "first_seq", "received_at", "sn", *STATUS_FIELDS]
    return _fold(prev.select(*cols).unionByName(new.select(*cols)))


def history(classified: DataFrame) -> DataFrame:
    """H2: append-only history keyed by ``(sn, event_ts)`` where
    ``event_ts`` is the arrival time at millisecond precision; of arrivals
    with the same key the first one is kept."""
    rows = status_rows(classified).withColumn("event_ts", round_ms(F.col("received_at")))
    first = F.struct("seq", "sn", *STATUS_FIELDS)
    g = rows.groupBy(sn_key("sn").alias("_k"), F.col("event_ts")).agg(
        F.min_by(first, "seq").alias("_f"))
    return g.select(
        plain(F.col("_f.sn")).alias("sn"),
        "event_ts",
        F.col("_f.last_seen").alias("last_seen"),
        F.col("_f.wan_ip").alias("wan_ip"),
        F.col("_f.sw_version").alias("sw_version"),
        F.col("_f.cpu_pct").cast("tinyint").alias("cpu_pct"),
        F.col("_f.mem_pct").cast("tinyint").alias("mem_pct"),
    )


def heartbeat_outcomes(classified: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """H3: final outcome per arrival.  A row that updated the status but
    lost the history key to an earlier arrival in the same millisecond ends
    as 500 (the two writes are not atomic).  One shuffle on the history key
    (device + millisecond), which spreads a chatty device over many keys.

    ``stored`` (``sn, event_ts`` of history written by earlier batches) makes
    a batch see the keys that are already taken."""
    # Rows that are not 202 take part in no key: give each its own window
    # partition (by seq) so they never pile up under one NULL key.
    d = (classified
         .withColumn("_ets", F.when(F.col("code") == 202, round_ms(F.col("received_at"))))
         .withColumn("_solo", F.when(F.col("code") != 202, F.col("seq")))
         .withColumn("_k", sn_key("sn")))
    taken = F.lit(False)
    if stored is not None:
        old = stored.select(sn_key("sn").alias("_ok"), F.col("event_ts").alias("_oets")).distinct().withColumn("_taken", F.lit(True))
        d = d.join(old, (d["_k"] == old["_ok"]) & (d["_ets"] == old["_oets"]), "left")
        taken = F.coalesce("_taken", F.lit(False))
    w = Window.partitionBy("_k", F.col("_ets"), F.col("_solo"))
    first = F.min("seq").over(w)
    lost = (F.col("code") == 202) & (taken | (F.col("seq") != first))
    return d.select(
        *[c for c in classified.columns if c not in ("code", "reason")],
        F.when(lost, F.lit(500)).otherwise(F.col("code")).cast("int").alias("code"),
        F.when(lost, F.lit("history_conflict")).otherwise(F.col("reason")).alias("reason"),
    )
