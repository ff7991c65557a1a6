"""Skew-safe per-series ordering primitives.

Ordered per-series work (previous/next sample, running counts, islands)
normally means ``Window.partitionBy(series).orderBy(ts)``, which puts a whole
series on one task.  When one series holds a third of all rows that task
becomes the job.  Here each series is split into time buckets: the window
runs per ``(series, bucket)`` in parallel, and what crosses a bucket
boundary comes from a per-bucket summary (one row per series and bucket,
orders of magnitude smaller than the samples) that is joined back on the
same ``(series, bucket)`` key.

The summary is aggregated from the *windowed* rows, so both branches read
the same shuffle of the samples (Spark reuses the exchange) and the
aggregation needs no shuffle of its own: the samples cross the network
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions.exprs import idiv

BUCKET = "_bucket"
_ROW, _CNT = "_rn", "_cnt"


def bucket_of(ts: str, split_seconds: int):
    return idiv(F.unix_micros(F.col(ts).cast("timestamp")), split_seconds * 1_000_000)


def _windowed(df: DataFrame, series: list[str], order: list[str], split_seconds: int,
              extra, one_per_time: str | None = None) -> tuple[DataFrame, Window, Window]:
    d = df.withColumn(BUCKET, bucket_of(order[0], split_seconds))
    if one_per_time:
        # the last of equal times stays; same partitioning, so no shuffle of its own
        following = F.lead(order[0]).over(Window.partitionBy(*series, BUCKET).orderBy(order[0], one_per_time))
        d = d.withColumn("_following", following).where(~F.col("_following").eqNullSafe(F.col(order[0]))).drop("_following")
    w = Window.partitionBy(*series, BUCKET).orderBy(*order)
    wp = Window.partitionBy(*series, BUCKET)
    ws = Window.partitionBy(*series).orderBy(BUCKET)
    cols = [F.col(c) for c in d.columns] + [
        F.row_number().over(w).alias(_ROW), F.count(F.lit(1)).over(wp).alias(_CNT)] + extra(w)
    return d.select(*cols), w, ws


def _order(ts: str, tiebreak) -> list[str]:
    if not tiebreak:
        return [ts]
    return [ts] + ([tiebreak] if isinstance(tiebreak, str) else list(tiebreak))


def neighbors(df: DataFrame, series: list[str], ts: str, cols: list[str],
              tiebreak: str | list[str] | None = None, split_seconds: int = 86_400,
              want_prev: bool = True, want_next: bool = False, one_per_time: str | None = None) -> DataFrame:
    """Add ``prev_<c>``/``next_<c>`` for ``c`` in ``[ts] + cols`` from the
    neighbouring row of the same series in ``(ts, *tiebreak)`` order.  With
    ``one_per_time`` only the row with the greatest such value stays of rows
    with one time."""
    order = _order(ts, tiebreak)
    carried = list(dict.fromkeys([ts] + cols))
    every = [c for c in df.columns if c not in series]

    def extra(w):
        out = []
        if want_prev:
            out += [F.lag(F.col(c)).over(w).alias(f"_lp_{c}") for c in carried]
        if want_next:
            out += [F.lead(F.col(c)).over(w).alias(f"_ln_{c}") for c in carried]
        return out

    d, w, ws = _windowed(df, series, order, split_seconds, extra, one_per_time)
    # Every input column goes into the summary structs so both branches
    # project the same columns before the shared exchange.
    row = F.struct(*[F.col(c) for c in every])
    s = d.groupBy(*series, BUCKET).agg(
        F.max_by(row, F.when(F.col(_ROW) == F.col(_CNT), F.lit(1))).alias("_last"),
        F.max_by(row, F.when(F.col(_ROW) == 1, F.lit(1))).alias("_first"))
    carry = s.select(*series, BUCKET,
                     *([F.lag("_last").over(ws).alias("_cp")] if want_prev else []),
                     *([F.lead("_first").over(ws).alias("_cn")] if want_next else []))
    j = d.join(carry, series + [BUCKET], "left")
    out = [F.col(c) for c in df.columns] + [F.col(BUCKET)]
    for c in carried:
        if want_prev:
            out.append(F.when(F.col(_ROW) == 1, F.col(f"_cp.{c}"))
                       .otherwise(F.col(f"_lp_{c}")).alias(f"prev_{c}"))
        if want_next:
            out.append(F.when(F.col(_ROW) == F.col(_CNT), F.col(f"_cn.{c}"))
                       .otherwise(F.col(f"_ln_{c}")).alias(f"next_{c}"))
    return j.select(*out)


def running_count(df: DataFrame, partition: list[str], ts: str,
                  tiebreak: str | list[str] | None = None,
                  split_seconds: int = 3_600, name: str = "running_count") -> DataFrame:
    """1-based running count of rows per ``partition`` in ``(ts, tiebreak)``
    order: row number within ``(partition, bucket)`` plus the rows of the
    earlier buckets (running sum over the per-bucket counts)."""
    order = _order(ts, tiebreak)
    d, w, ws = _windowed(df, partition, order, split_seconds, lambda w: [])
    s = d.groupBy(*partition, BUCKET).agg(F.max(_CNT).alias("_n"))
    before = F.coalesce(F.sum("_n").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.select(*partition, BUCKET, before.alias("_before"))
    j = d.join(s, partition + [BUCKET], "left")
    return j.select(*[F.col(c) for c in df.columns],
                    (F.col(_ROW) + F.col("_before")).cast("long").alias(name))


def islands(df: DataFrame, series: list[str], ts: str, flag: str,
            split_seconds: int = 86_400, gap_seconds: float | None = None) -> DataFrame:
    """Runs of equal ``flag`` per series in ``ts`` order, in one windowed
    pass; a distance of more than ``gap_seconds`` ends a run as well.  Of rows
    with one time the one with the greatest flag stays.  Adds ``island`` (ts of the run's first row) and ``next_ts`` (ts
    of the following row of the series, NULL for the last one).

    Per bucket the window finds local run starts (excluding the bucket's
    first row); the summary says whether the first row continues the
    previous bucket's run, and the island of a bucket's last row is the
    last non-null "anchor" over the buckets so far."""
    u = Window.unboundedPreceding

    def extra(w):
        return [F.lag(F.col(flag)).over(w).alias("_pf"), F.lead(F.col(ts)).over(w).alias("_nts"),
                F.lag(F.col(ts)).over(w).alias("_pts")]

    def far(a, b):
        if gap_seconds is None:
            return F.lit(False)
        us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
        return us(b) - us(a) > round(gap_seconds * 1_000_000)

    d, w, ws = _windowed(df, series, [ts], split_seconds, extra, flag)
    start = F.when((F.col(_ROW) > 1) & ((F.col(flag) != F.col("_pf")) | far("_pts", ts)), F.col(ts))
    d = d.withColumn("_ls", start)
    d = d.withColumn("_lls", F.last("_ls", ignorenulls=True).over(w.rowsBetween(u, 0)))
    s = d.groupBy(*series, BUCKET).agg(
        F.min(ts).alias("_fts"), F.max(ts).alias("_lts"),
        F.max_by(F.col(flag), F.when(F.col(_ROW) == 1, F.lit(1))).alias("_ff"),
        F.max_by(F.col(flag), F.when(F.col(_ROW) == F.col(_CNT), F.lit(1))).alias("_lf"),
        F.max("_ls").alias("_lastls"))
    s = s.select("*", F.lag("_lf").over(ws).alias("_plf"), F.lag("_lts").over(ws).alias("_plts"), F.lead("_fts").over(ws).alias("_nfts"))
    cont = F.col("_plf").isNotNull() & (F.col("_plf") == F.col("_ff")) & ~far("_plts", "_fts")
    s = s.withColumn("_cont", cont).withColumn(
        "_anchor", F.coalesce(F.col("_lastls"), F.when(~cont, F.col("_fts"))))
    s = s.withColumn("_isl_last", F.last("_anchor", ignorenulls=True).over(ws.rowsBetween(u, 0)))
    s = s.select(*series, BUCKET, "_nfts",
                 F.when(F.col("_cont"), F.lag("_isl_last").over(ws))
                 .otherwise(F.col("_fts")).alias("_isl_first"))
    j = d.join(s, series + [BUCKET], "left")
    return j.select(*[F.col(c) for c in df.columns],
                    F.coalesce(F.col("_lls"), F.col("_isl_first")).alias("island"),
                    F.when(F.col(_ROW) == F.col(_CNT), F.col("_nfts"))
                    .otherwise(F.col("_nts")).alias("next_ts"))
