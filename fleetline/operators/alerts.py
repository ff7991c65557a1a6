"""Duration alerts (A1-A6): a condition must hold at every evaluation for
at least ``for`` before the alert fires; one false evaluation resets it.

Gaps and islands per series: a run starts where the condition differs
from the previous sample of the same series; the island of a row is the
latest run start at or before it.  Both steps use the bucketed, skew-safe
primitives of ``series``; the islands themselves are a grouped aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.operators.series import islands


def for_duration(samples: DataFrame, series: list[str], condition: Column, for_seconds: float,
                 ts: str = "ts", split_seconds: int = 86_400, step_seconds: float | None = None) -> DataFrame:
    """Firing intervals: ``series..., pending_at, fired_at, last_true_at,
    resolved_at``.  ``fired_at`` is the first evaluation with
    ``ts - pending_at >= for``; ``resolved_at`` the first false evaluation
    after the island (NULL while still firing).  Islands that never reach
    ``for`` are not returned.  A NULL condition counts as false.

    ``step_seconds`` is the distance of evaluations (rows of a grid): where the
    next row is farther, an evaluation is missing, which resets the alert and
    resolves it one step after its last true evaluation."""
    d = samples.select(*series, ts, F.coalesce(condition, F.lit(False)).alias("_c"))
    m = islands(d, series, ts, "_c", split_seconds, step_seconds)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = us(ts) - us("island") >= int(for_seconds * 1_000_000)
    following = F.col("next_ts")
    if step_seconds is not None:
        step = round(step_seconds * 1_000_000)
        following = F.when(us("next_ts") - us(ts) > step, F.timestamp_micros(us(ts) + step).cast("timestamp_ntz")).otherwise(following)
    g = m.withColumn("_following", following).where("_c").groupBy(*series, "island").agg(
        F.min(F.when(held, F.col(ts))).alias("fired_at"),
        F.max(ts).alias("last_true_at"),
        F.max_by(F.col("_following"), F.col(ts)).alias("resolved_at"))
    return g.where(F.col("fired_at").isNotNull()).select(
        *series, F.col("island").alias("pending_at"), "fired_at", "last_true_at", "resolved_at")


def alert_state(series: list[str]) -> str:
    """DDL of the state that ``advance`` carries: one row per series with its
    last evaluation and, while the condition holds, since when and whether the
    alert has fired."""
    return ", ".join([*[f"{s} string" for s in series], "last_at timestamp_ntz", "holds boolean",
                      "pending_at timestamp_ntz", "fired_at timestamp_ntz"])


def advance(state: DataFrame, samples: DataFrame, series: list[str], condition: Column, for_seconds: float,
            ts: str = "ts", split_seconds: int = 86_400, step_seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """One batch of evaluations on top of the ``state`` (``alert_state``) that
    earlier ones left: the alerts that fired and are now resolved, and the new
    state.  Evaluations of a series come in time order across batches; rows not
    after its last one are ignored.  However the input is cut into batches, the
    resolved alerts of all of them and the firing ones of the last state are
    those of ``for_duration`` over everything.

    The state joins the batch as one more row per series, its last evaluation;
    an island that starts there goes on from the kept ``pending_at``."""
    held = state.select(*series, F.col("last_at").alias("_last"), F.col("holds").alias("_holds"),
                        F.col("pending_at").alias("_pend"), F.col("fired_at").alias("_fired"))
    d = samples.select(*series, ts, F.coalesce(condition, F.lit(False)).alias("_c")).join(held.select(*series, "_last"), series, "left")
    d = d.where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")
    d = d.unionByName(held.select(*series, F.col("_last").alias(ts), F.col("_holds").alias("_c")))
    m = islands(d, series, ts, "_c", split_seconds, step_seconds).join(held, series, "left")
    goes_on = F.col("_holds") & (F.col("island") == F.col("_last"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    m = m.withColumn("_since", F.when(goes_on, F.col("_pend")).otherwise(F.col("island")))
    fired = F.coalesce(F.min(F.when(goes_on, F.col("_fired"))),
                       F.min(F.when(us(ts) - us("_since") >= int(for_seconds * 1_000_000), F.col(ts))))
    following = F.col("next_ts")
    if step_seconds is not None:
        step = round(step_seconds * 1_000_000)
        following = F.when(us("next_ts") - us(ts) > step, F.timestamp_micros(us(ts) + step).cast("timestamp_ntz")).otherwise(following)
    g = m.withColumn("_following", following).groupBy(*series, "island", "_c").agg(
        F.min("_since").alias("pending_at"), fired.alias("fired_at"), F.max(ts).alias("last_true_at"),
        F.max_by("_following", ts).alias("resolved_at"))
    resolved = g.where(F.col("_c") & F.col("fired_at").isNotNull() & F.col("resolved_at").isNotNull()).select(
        *series, "pending_at", "fired_at", "last_true_at", "resolved_at")
    # the island without a following evaluation is the last one of its series
    now = g.where(F.col("resolved_at").isNull()).select(
        *series, F.col("last_true_at").alias("last_at"), F.col("_c").alias("holds"),
        F.when(F.col("_c"), F.col("pending_at")).alias("pending_at"), F.when(F.col("_c"), F.col("fired_at")).alias("fired_at"))
    return resolved, now


def firing(state: DataFrame, series: list[str]) -> DataFrame:
    """The alerts of a state that have fired and are not resolved."""
    return state.where(F.col("holds") & F.col("fired_at").isNotNull()).select(
        *series, "pending_at", "fired_at", F.col("last_at").alias("last_true_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))


_LABEL = re.compile(r"\{\{\s*\$labels\.([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


def render(alerts: DataFrame, template: str, name: str = "annotation") -> Column:
    """``{{ $labels.x }}`` substitution from the alert's label columns
    (a missing label renders empty)."""
    parts, pos = [], 0
    for m in _LABEL.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        label = m.group(1)
        parts.append(F.coalesce(F.col(label).cast("string"), F.lit(""))
                     if label in alerts.columns else F.lit(""))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return (F.concat(*parts) if parts else F.lit("")).alias(name)


def join_gauges(left: DataFrame, right: DataFrame, on: list[str], ts: str = "ts") -> DataFrame:
    """A5: two gauges on one evaluation grid (one value per labels and time,
    as ``metrics.latest_in_lookback`` gives them), matched on both."""
    return left.join(right, on + [ts], "inner")
