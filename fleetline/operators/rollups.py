"""Stored window rollups (W1-W8): a bucket table that late rows correct.

Per series and bucket of time the rollup holds the number of samples, the first
and the last one, and the sum of the increases between neighbours inside it.
Neighbouring buckets combine: the increase over an edge is that from the last
sample of one to the first of the next.  Sliding windows are then sums over
buckets, without the samples.

The samples are stored beside it, by day and hash of the series.  A batch adds
its samples and recomputes the rollup of the days and series buckets it
touches, whether its rows are new or late: nothing is dropped for being late,
and the windows at the end are there without waiting for a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetline.operators.metrics import _E, _T, _at, _bucket, _expand, _seconds, counter_deltas
from fleetline.session import ensure_semantics
from fleetline.sources.buckets import BUCKET, PART, BucketTable

EDGE = "struct<ts:timestamp_ntz,value:double>"


def rollup(samples: DataFrame, series: list[str], window: str, step: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(series..., _e, n, inside, first, last)`` per bucket that holds samples;
    of samples with one time the greatest value counts."""
    d = counter_deltas(samples.select(*series, ts, value), series, ts, value)
    d = d.withColumn(_E, _bucket(ts, window, step))
    own = _bucket("prev_ts", window, step) == F.col(_E)
    row = F.struct(F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return d.groupBy(*series, _E).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(own, F.col("delta"))), F.lit(0.0)).alias("inside"),
        F.min_by(row, ts).cast(EDGE).alias("first"), F.max_by(row, ts).cast(EDGE).alias("last"))


def increase(buckets: DataFrame, series: list[str], by: list[str], window: str, step: str, start=None, end=None,
             name: str = "increase") -> DataFrame:
    """``sum by (by) (increase(counter[window]))`` on the grid from a rollup:
    equal to ``metrics.increase_from_samples`` over its samples."""
    w = Window.partitionBy(*series).orderBy(_E)
    prev = F.lag("last").over(w)
    jump = F.when(prev.isNull(), F.lit(None)).when(F.col("first.value") < prev["value"], F.col("first.value")).otherwise(
        F.col("first.value") - prev["value"])
    b = buckets.select(*series, _E, "n", "inside", F.struct(jump.cast("double").alias("jump")).alias("_edge"))
    keys = list(dict.fromkeys([*series, *by]))
    per = _expand(b, window, step, start, end).groupBy(*keys, _T).agg(
        F.sum("n").alias("_n"), F.sum(F.col("inside") + F.coalesce(F.col("_edge.jump"), F.lit(0.0))).alias("_inc"), F.min_by("_edge", _E).alias("_first"))
    # the increase into the window's first sample comes from outside of it
    inc = F.col("_inc") - F.coalesce(F.col("_first.jump"), F.lit(0.0))
    g = per.where(F.col("_n") >= 2).groupBy(*by, _T).agg(F.sum(inc).alias(name))
    return g.select(_at(_T).alias("t"), *by, name)


def rate(buckets: DataFrame, series: list[str], by: list[str], window: str, step: str, start=None, end=None) -> DataFrame:
    inc = increase(buckets, series, by, window, step, start, end)
    return inc.select("t", *by, (F.col("increase") / _seconds(window)).alias("rate"))


class RollupStore:
    """Samples ``(series..., ts, value)`` and their rollup under ``root``."""

    def __init__(self, spark: SparkSession, root: str, series: list[str], window: str, step: str, buckets: int = 8):
        ensure_semantics(spark)
        self.spark, self.series, self.window, self.step, self.buckets = spark, series, window, step, buckets
        keys = ", ".join(f"{s} string" for s in series)
        self.samples = BucketTable(spark, f"{root}/samples", f"{keys}, ts timestamp_ntz, value double", buckets)
        self.table = BucketTable(
            spark, f"{root}/rollup", f"{keys}, {_E} long, n long, inside double, first {EDGE}, last {EDGE}", buckets)

    def add(self, batch: DataFrame, number: int) -> None:
        """A batch of samples, in any order of time.  One that is done is skipped."""
        placed = batch.select(*self.series, "ts", F.col("value").cast("double").alias("value"))
        # a bucket of the rollup ends at most one width after its samples: the day of its end holds it whole
        day = F.date_format(F.timestamp_micros(_bucket("ts", self.window, self.step) - 1), "yyyy-MM-dd")
        placed = placed.withColumn(PART, day).withColumn(BUCKET, F.pmod(F.xxhash64(*self.series), F.lit(self.buckets)).cast("int"))
        if self.table.is_done("samples", number):
            return
        if not self.samples.is_done("samples", number):
            self.samples.publish(placed, feed="samples", batch=number)
        touched: dict[str, list[int]] = {}
        for r in placed.select(PART, BUCKET).distinct().collect():
            touched.setdefault(r[PART], []).append(r[BUCKET])
        # one bucket of the samples is one group of series and one day: the rollup of all touched ones is one plan
        made = rollup(self.samples.read_at(touched), [*self.series, PART, BUCKET], self.window, self.step)
        self.table.publish(made, touched, "samples", number)

    def read(self) -> DataFrame:
        return self.table.read().drop(PART, BUCKET)

    def rate(self, by: list[str], start=None, end=None) -> DataFrame:
        return rate(self.read(), self.series, by, self.window, self.step, start, end)


def rollup_stream(samples: DataFrame, store: RollupStore, checkpoint: str, available_now: bool = True, interval: str = "1 second"):
    """Samples as a stream into a ``RollupStore``."""
    w = samples.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
