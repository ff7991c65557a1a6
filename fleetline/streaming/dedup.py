"""Re-sent webhooks dropped within a bound (§2.12, the unique key of the queue).

The queue folds re-sent events by key for ever, at the price of its key table.
A feed that delivers requests twice within minutes needs less: the stream keeps
the keys of the last ``bound`` of event time and drops what repeats one, in
state whose size follows the traffic of one bound, not the history.

Keys are the byte-exact ``(sn, event_ts)`` of a request, as a re-sent request
has the same bytes; other spellings pass and are folded by the queue.  A repeat
that comes after its key's bound passes again, and a row older than the
watermark is dropped unseen.  Neither is silent: ``past_bound`` counts the
repeats that passed, ``late_rows`` the rows that were dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline import schemas as S
from fleetline.operators import ingest
from fleetline.session import ensure_semantics

COLUMNS = ("seq", "received_at", "sn", "event_ts", "payload")


def accepted(arrivals: DataFrame, secret: str) -> DataFrame:
    c = ingest.classify_webhook(arrivals, secret)
    return c.where(F.col("code") == 202).select(*COLUMNS)


def without_resent(accepted_stream: DataFrame, bound: str = "1 hour") -> DataFrame:
    """The stream of accepted webhooks without repeats of a key within ``bound``."""
    d = accepted_stream.withColumn("_at", F.col("received_at").cast("timestamp")).withWatermark("_at", bound)
    return d.dropDuplicatesWithinWatermark(["sn", "event_ts"]).drop("_at")


def dedup_stream(spark: SparkSession, source_dir: str, sink: str, checkpoint: str, secret: str, bound: str = "1 hour",
                 max_files_per_trigger: int | None = None, available_now: bool = True, interval: str = "1 second"):
    """Webhook arrival files -> accepted webhooks, first of each key, as Parquet."""
    ensure_semantics(spark)
    r = spark.readStream.schema(S.WEBHOOK_ARRIVAL_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    out = without_resent(accepted(r.parquet(source_dir), secret), bound)
    w = out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def late_rows(query) -> int:
    """Rows that came after the watermark, over the query's kept progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def past_bound(sunk: DataFrame) -> DataFrame:
    """Repeats that passed: per key the rows in the sink beyond the first."""
    return sunk.groupBy("sn", "event_ts").agg((F.count(F.lit(1)) - 1).alias("repeats")).where("repeats > 0")


def first_of_key(accepted_rows: DataFrame) -> DataFrame:
    """The batch result: the first arrival of every byte-exact key."""
    first = F.min_by(F.struct(*COLUMNS), "seq").alias("_f")
    return accepted_rows.groupBy("sn", "event_ts").agg(first).select("_f.*")
