"""Alerts carried between micro-batches (A-core): pending, firing, resolved.

The state of ``alerts.advance`` (a row per series) is a version of a
``BucketTable`` per batch; alerts that a batch resolves are written under its
batch id.  A batch costs its own evaluations and one row per series."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.operators import alerts
from fleetline.sources.buckets import BUCKET, PART, BucketTable, columns
from fleetline.streaming.parts import exists, write_partition

RESOLVED = "pending_at timestamp_ntz, fired_at timestamp_ntz, last_true_at timestamp_ntz, resolved_at timestamp_ntz"


@dataclass
class AlertRule:
    """A rule over evaluations ``(series..., ts, ...)``."""
    name: str
    series: list[str]
    condition: Column
    for_seconds: float
    ts: str = "t"
    step_seconds: float | None = None
    buckets: int = field(default=4)


class AlertStore:
    """State and resolved alerts of one rule under ``root``."""

    def __init__(self, spark: SparkSession, root: str, rule: AlertRule):
        self.spark, self.rule, self.root = spark, rule, f"{root.rstrip('/')}/{rule.name}"
        self.state = BucketTable(spark, f"{self.root}/state", alerts.alert_state(rule.series), rule.buckets)

    def advance(self, samples: DataFrame, batch: int) -> None:
        """A batch of evaluations; one that is done is skipped."""
        r = self.rule
        if self.state.is_done("evaluations", batch):
            return
        before, samples = self.state.read().drop(PART, BUCKET), samples.persist()  # both outputs read the batch
        resolved, now = alerts.advance(before, samples, r.series, r.condition, r.for_seconds, r.ts, step_seconds=r.step_seconds)
        write_partition(resolved, f"{self.root}/resolved", batch)
        rows = now.withColumn(PART, F.lit("series")).withColumn(BUCKET, F.pmod(F.xxhash64(*r.series), F.lit(r.buckets)).cast("int"))
        self.state.publish(rows, {"series": list(range(r.buckets))}, "evaluations", batch)
        samples.unpersist()

    def resolved(self) -> DataFrame:
        schema = ", ".join([*[f"{s} string" for s in self.rule.series], RESOLVED])
        path = f"{self.root}/resolved"
        return (self.spark.read.schema(schema).parquet(path).select(*columns(schema))
                if exists(self.spark, path) else self.spark.createDataFrame([], schema))

    def alerts(self) -> DataFrame:
        """All alerts so far: the resolved ones and those still firing."""
        return self.resolved().unionByName(alerts.firing(self.state.read(), self.rule.series))


def alert_stream(evaluations: DataFrame, root: str, rule: AlertRule, checkpoint: str, available_now: bool = True,
                 interval: str = "1 second"):
    """Evaluations as a stream into an ``AlertStore``."""
    store = AlertStore(evaluations.sparkSession, root, rule)
    w = evaluations.writeStream.foreachBatch(store.advance).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
