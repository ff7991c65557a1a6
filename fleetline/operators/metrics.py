"""Counters, gauges and sliding-window rates.

Counters and gauges over a log of classified arrivals are grouped counts and
last values.  The sliding-window functions evaluate PromQL-style range
functions on an evaluation grid: the window ending at T covers (T - w, T].

Rows are first aggregated to buckets (base width: the greatest common divisor
of window and step) and only this small table is expanded to the grid points
whose window holds the bucket, so raw rows are never copied per point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.functions.exprs import idiv
from fleetline.operators.series import neighbors

_E, _T = "_e", "_t"  # bucket end and grid point, in microseconds


def counter(df: DataFrame, by: list[str], name: str = "value") -> DataFrame:
    """Grouped count (partial + final hash aggregation)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def gauge_last(df: DataFrame, key: str, values: list[str], order: str = "seq") -> DataFrame:
    """Last non-null value of each gauge per ``key`` by arrival order.  A
    key whose gauge was never set has NULL for it."""
    aggs = [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return df.groupBy(key).agg(*aggs)


def _seconds(interval: str) -> float:
    n, unit = interval.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600,
            "hours": 3600, "day": 86400, "days": 86400}[unit]
    return float(n) * mult


def _micros(interval: str) -> int:
    return round(_seconds(interval) * 1_000_000)


def _bucket(ts: str, window: str, step: str) -> Column:
    """End of the bucket (e - base, e] that holds ``ts``."""
    base = math.gcd(_micros(window), _micros(step))
    return ((idiv(F.unix_micros(F.col(ts).cast("timestamp")) - 1, base) + 1) * F.lit(base)).cast("long").alias(_E)


def _at(t) -> Column:
    return F.timestamp_micros(t).cast("timestamp_ntz")


def _point(at) -> Column | None:
    """A time (literal or column) in microseconds."""
    if at is None:
        return None
    at = F.lit(at).cast("timestamp_ntz") if not isinstance(at, Column) else at
    return F.unix_micros(at.cast("timestamp"))


def _expand(buckets: DataFrame, window: str, step: str, start=None, end=None) -> DataFrame:
    """One row per bucket and grid point T in [start, end] whose window holds it."""
    w, s = _micros(window), _micros(step)
    base = math.gcd(w, s)
    first = (idiv(F.col(_E) - 1, s) + 1) * F.lit(s)
    last = F.col(_E) + F.lit(w - base)
    d = buckets.withColumn(_T, F.explode(F.when(first <= last, F.sequence(first, last, F.lit(s).cast("long")))))
    if start is not None:
        d = d.where(F.col(_T) >= _point(start))
    return d if end is None else d.where(F.col(_T) <= _point(end))


def _without_holes(points: DataFrame, by: list[str], name: str, step: str) -> DataFrame:
    """Adds a zero for every grid point between a series' first and last one:
    a counter that exists and did not rise has increase 0."""
    span = points.groupBy(*by).agg(F.min(_T).alias("_lo"), F.max(_T).alias("_hi"))
    grid = span.select(*by, F.explode(F.sequence("_lo", "_hi", F.lit(_micros(step)).cast("long"))).alias(_T),
                       F.lit(0.0).alias(name))
    return points.select(*by, _T, name).unionByName(grid).groupBy(*by, _T).agg(F.sum(name).alias(name))


def increase_from_events(events: DataFrame, ts: str, by: list[str], window: str = "5 minutes",
                         step: str = "1 minute", name: str = "increase", start=None, end=None) -> DataFrame:
    """Counter increase from the event log itself: number of events in
    (T - w, T] per ``by`` and grid point T within [start, end], zeros between
    the first and the last point of a series included."""
    b = events.groupBy(*by, _bucket(ts, window, step)).agg(F.count(F.lit(1)).cast("double").alias(name))
    g = _expand(b, window, step, start, end).groupBy(*by, _T).agg(F.sum(name).alias(name))
    return _without_holes(g, by, name, step).select(_at(_T).alias("t"), *by, name)


def rate_from_events(events: DataFrame, ts: str, by: list[str], window: str = "5 minutes",
                     step: str = "1 minute", start=None, end=None) -> DataFrame:
    """Per-second rate = increase / window length."""
    inc = increase_from_events(events, ts, by, window, step, "increase", start, end)
    return inc.select("t", *by, (F.col("increase") / _seconds(window)).alias("rate"))


def counter_deltas(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value",
                   split_seconds: int = 86_400) -> DataFrame:
    """Per sample: ``delta`` = value - previous value of the series, or the
    value itself after a counter reset (value went down); NULL for the first
    sample.  Previous sample per series via the skew-safe ``neighbors``; of
    samples with one time the greatest value counts."""
    n = neighbors(samples, series, ts, [value], split_seconds=split_seconds, one_per_time=value)
    v, p = F.col(value), F.col(f"prev_{value}")
    delta = F.when(p.isNull(), F.lit(None)).when(v < p, v).otherwise(v - p)
    return n.select(*samples.columns, F.col(f"prev_{ts}").alias("prev_ts"),
                    delta.cast("double").alias("delta"))


def increase_from_samples(samples: DataFrame, series: list[str], by: list[str], ts: str = "ts",
                          value: str = "value", window: str = "5 minutes", step: str = "1 minute",
                          split_seconds: int = 86_400, name: str = "increase", start=None, end=None) -> DataFrame:
    """``sum by (by) (increase(counter[w]))`` on the grid, without PromQL's
    extrapolation to the window edges: per series and window, the sum of the
    deltas whose two samples both lie in (T - w, T]; series with fewer than
    two samples in a window drop out.  The one delta that reaches out of a
    window is that of its first sample, so buckets carry it apart."""
    keys = list(dict.fromkeys([*series, *by]))
    d = counter_deltas(samples, series, ts, value, split_seconds)
    b = d.groupBy(*keys, _bucket(ts, window, step)).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("delta").alias("_inc"),
        F.min_by(F.struct(F.col("delta").alias("delta")), ts).alias("_first"))
    per = _expand(b, window, step, start, end).groupBy(*keys, _T).agg(
        F.sum("_n").alias("_n"), F.sum("_inc").alias("_inc"), F.min_by("_first", _E).alias("_first"))
    inc = F.coalesce("_inc", F.lit(0.0)) - F.coalesce(F.col("_first.delta"), F.lit(0.0))
    g = per.where(F.col("_n") >= 2).groupBy(*by, _T).agg(F.sum(inc).alias(name))
    return g.select(_at(_T).alias("t"), *by, name)


def rate_from_samples(samples: DataFrame, series: list[str], by: list[str], ts: str = "ts",
                      value: str = "value", window: str = "5 minutes", step: str = "1 minute",
                      split_seconds: int = 86_400, start=None, end=None) -> DataFrame:
    inc = increase_from_samples(samples, series, by, ts, value, window, step, split_seconds, "increase", start, end)
    return inc.select("t", *by, (F.col("increase") / _seconds(window)).alias("rate"))


def matching(samples: DataFrame, matchers: list[tuple[str, str, str]], labels: str = "labels") -> DataFrame:
    """The samples whose label map meets every matcher ``(label, op,
    value)`` with ``=``, ``!=``, ``=~`` or ``!~``.  A missing label is the empty
    text and a regex matches the whole value.  The matchers are filters on the
    rows, so they run before anything is grouped or shuffled by series."""
    for label, op, value in matchers:
        got = F.coalesce(F.try_element_at(F.col(labels), F.lit(label)), F.lit(""))
        meets = {"=": got == value, "!=": got != value, "=~": got.rlike(f"^(?:{value})$"), "!~": ~got.rlike(f"^(?:{value})$")}[op]
        samples = samples.where(meets)
    return samples


def label_columns(samples: DataFrame, names: list[str], labels: str = "labels") -> DataFrame:
    """The named labels as columns (null where missing), and ``series``, all
    labels in order of their names: what tells one series from another."""
    entries = F.sort_array(F.filter(F.map_entries(labels), lambda e: e["value"] != ""))
    return samples.select(*[c for c in samples.columns if c != labels], entries.alias("series"),
                          *[F.try_element_at(F.col(labels), F.lit(n)).alias(n) for n in names])


def latest_in_lookback(samples: DataFrame, series: list[str], by: list[str], ts: str = "ts",
                       value: str = "value", lookback: str = "5 minutes",
                       step: str = "1 minute", label_regex: dict | None = None,
                       name: str = "value", start=None, end=None) -> DataFrame:
    """Instant vector at each grid point T (latest sample per series in
    (T - lookback, T], of samples with one time the greatest value), optional
    anchored label regexes, ``sum by``."""
    s = samples
    for col, rx in (label_regex or {}).items():
        s = s.where(F.col(col).rlike(f"^(?:{rx})$"))
    keys = list(dict.fromkeys([*series, *by]))
    b = s.groupBy(*keys, _bucket(ts, lookback, step)).agg(F.max_by(F.col(value), F.struct(ts, value)).alias("_v"))
    per = _expand(b, lookback, step, start, end).groupBy(*keys, _T).agg(F.max_by("_v", _E).alias("_v"))
    return per.groupBy(*by, _T).agg(F.sum("_v").alias(name)).select(_at(_T).alias("t"), *by, name)


def ratio_pct(events: DataFrame, ts: str, numerator, window: str = "5 minutes",
              step: str = "1 minute", by: list[str] | None = None,
              name: str = "pct", start=None, end=None) -> DataFrame:
    """``sum(rate(x{num}[w])) / sum(rate(x[w])) * 100`` from the event
    log in one pass (two conditional counts); grid points without traffic
    give no row."""
    by = by or []
    b = events.groupBy(*by, _bucket(ts, window, step)).agg(
        F.count_if(numerator).alias("_num"), F.count(F.lit(1)).alias("_den"))
    g = _expand(b, window, step, start, end).groupBy(*by, _T).agg(F.sum("_num").alias("_num"), F.sum("_den").alias("_den"))
    pct = F.try_divide(F.col("_num").cast("double"), F.col("_den").cast("double")) * 100.0
    return g.select(_at(_T).alias("t"), *by, pct.alias(name)).where(F.col(name).isNotNull())


def time_range(df: DataFrame, ts: str, as_of, span: str = "30 minutes", lookback: str = "0 seconds") -> tuple[DataFrame, Column, Column]:
    """The rows that evaluations at start = as_of - span up to as_of can
    see, (start - lookback, as_of] (pushed to the scan when ``ts`` is a stored
    column), with both ends of the evaluation range."""
    end = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    start = end - F.make_dt_interval(secs=F.lit(_seconds(span)))
    first = start - F.make_dt_interval(secs=F.lit(_seconds(lookback)))
    return df.where((F.col(ts) > first) & (F.col(ts) <= end)), start, end
