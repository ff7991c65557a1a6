"""Structured Streaming drivers.

The same operators as the batch plans run inside ``foreachBatch``.  Every
write is keyed by the micro-batch id, so a batch that is re-run after a
failure (executor loss, restart from the checkpoint) replaces its own
output instead of appending twice:

* history / outcomes / arrivals: appended under ``batch_id=<n>`` partitions,
  which a re-run of the batch replaces;
* latest state and queue: versions of a ``BucketTable``, in which a batch
  rewrites the buckets of its own devices or events and no others; a batch
  that is done is skipped.

Sources are file streams of arrival records (``seq, received_at, body``);
a Kafka source can be swapped in with the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetline import schemas as S
from fleetline.operators import ingest, metrics, state
from fleetline.operators.state import sn_key
from fleetline.session import ensure_semantics
from fleetline.sources.buckets import BUCKET, PART, BucketTable, with_bucket
from fleetline.streaming.history_table import HistoryTable
from fleetline.streaming.parts import exists, write_partition
from fleetline.streaming.queue_store import ARRIVALS, TRANSITIONS, QueueStore

STATUS = (
    "sn string, last_seen timestamp_ntz, wan_ip string, sw_version string, cpu_pct tinyint, mem_pct tinyint, "
    "updated_at timestamp_ntz, received_at timestamp_ntz, seq long, first_seq long")
STATUS_BUCKETS = 16


def status_store(spark: SparkSession, sink_root: str, buckets: int = STATUS_BUCKETS) -> BucketTable:
    """The latest state per device, bucketed by the folded serial number."""
    return BucketTable(spark, f"{sink_root}/status", STATUS, buckets)


def current_status(spark: SparkSession, sink_root: str, buckets: int = STATUS_BUCKETS) -> DataFrame:
    """The newest version of the latest state."""
    return status_store(spark, sink_root, buckets).read().drop(PART, BUCKET)


def merge_status(store: BucketTable, classified: DataFrame, batch_id: int) -> list[int]:
    """H4 on the stored state: only the buckets of the batch's devices are read
    and rewritten; returns them.  A batch that is done changes nothing."""
    devices = with_bucket(state.latest_state(classified, keep_order_columns=True), store.buckets, sn_key("sn")).persist()
    try:
        touched = sorted(r[0] for r in devices.select(BUCKET).distinct().collect())
        if not store.is_done("heartbeats", batch_id):
            rows = devices
            if store.versions():
                rows = with_bucket(state.merge_states(store.read(buckets=touched), devices), store.buckets, sn_key("sn"))
            store.publish(rows.withColumn(PART, F.lit("device")), {"device": touched}, "heartbeats", batch_id)
        return touched
    finally:
        devices.unpersist()


def process_heartbeat_batch(batch: DataFrame, batch_id: int, sink_root: str) -> None:
    """One micro-batch of heartbeats: classify, the status buckets of its
    devices, history (deduplicated within the batch and against stored history
    of the same days), outcomes."""
    spark = batch.sparkSession
    ensure_semantics(spark)
    c = ingest.classify_heartbeat(batch).persist()
    store, table = status_store(spark, sink_root), HistoryTable(spark, f"{sink_root}/history")
    marked = None
    try:
        touched = merge_status(store, c, batch_id)
        device = store.read(buckets=touched).select(sn_key("sn").alias("_k"), F.col("first_seq").alias("device"))
        new = state.history(c)
        marked = table.marked(new.join(device, sn_key(new["sn"]) == device["_k"]).drop("_k"), batch_id).persist()
        outcomes = state.heartbeat_outcomes(c, marked.where("taken").select("sn", "event_ts")).drop("body")
        write_partition(outcomes, f"{sink_root}/outcomes", batch_id)
        table.append(marked.where("not taken"), batch_id)
    finally:
        c.unpersist()
        if marked is not None:
            marked.unpersist()


def process_webhook_batch(batch: DataFrame, batch_id: int, sink_root: str, secret: str) -> None:
    """One micro-batch of webhooks: classified outcomes, the accepted arrivals
    appended to the arrivals log, and the queue with them."""
    spark = batch.sparkSession
    ensure_semantics(spark)
    c = ingest.classify_webhook(batch, secret)
    write_partition(c.drop("body", "payload"), f"{sink_root}/webhook_outcomes", batch_id)
    arr = c.where(F.col("code") == 202).select("seq", "received_at", "sn", "event_ts", "payload")
    write_partition(arr, f"{sink_root}/queue_arrivals", batch_id)
    written = spark.read.schema(ARRIVALS).parquet(f"{sink_root}/queue_arrivals/batch_id={batch_id}") if exists(
        spark, f"{sink_root}/queue_arrivals/batch_id={batch_id}") else spark.createDataFrame([], ARRIVALS)
    QueueStore(spark, f"{sink_root}/queue").enqueue(written, batch_id)


def drain_batch(spark: SparkSession, sink_root: str, as_of, batch_id: int, limit: int = 50) -> DataFrame:
    """Q8 as one writer tick over the stored queue: drains up to ``limit`` ready
    events of the open part, writes the transitions and one tick row under
    ``batch_id``, then moves the drained events to the finished ones.  A tick
    that is done returns the transitions it has written."""
    ensure_semantics(spark)
    store = QueueStore(spark, f"{sink_root}/queue")
    path = f"{sink_root}/transitions/batch_id={batch_id}"
    if not store.state.is_done("ticks", batch_id):
        out = store.tick(as_of, limit).withColumn("seq", F.col("seq") + F.lit(batch_id) * 2)
        seen = Observation()
        write_partition(out.observe(seen, F.count_if(F.col("status") == "done").alias("done")), f"{sink_root}/transitions", batch_id)
        tick = spark.range(1).select(F.lit(as_of).cast("timestamp_ntz").alias("at"), F.lit(limit).alias("batch_size"),
                                     F.lit(seen.get["done"]).cast("long").alias("drained"))
        write_partition(tick, f"{sink_root}/ticks", batch_id)
    done = spark.read.schema(TRANSITIONS).parquet(path) if exists(spark, path) else spark.createDataFrame([], TRANSITIONS)
    store.apply(done, "ticks", batch_id)
    return done


def drain_stream(spark: SparkSession, sink_root: str, checkpoint: str, limit: int = 50,
                 interval: str = "1 second", compact_every: int = 60):
    """The writer loop as a stream: one micro-batch per trigger interval
    (a rate source supplies the tick times), each running ``drain_batch``;
    every ``compact_every`` ticks crowded buckets of the queue are joined."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(df, batch_id):
        last = df.agg(F.max("timestamp").alias("t")).first()["t"]
        if last is not None:
            drain_batch(spark, sink_root, last, batch_id, limit)
            if compact_every and batch_id % compact_every == compact_every - 1:
                QueueStore(spark, f"{sink_root}/queue").compact()

    return (ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(processingTime=interval).start())


def _start(df: DataFrame, fn, checkpoint: str, available_now: bool, processing_time: str | None):
    w = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 second")
    return w.start()


def heartbeat_stream(spark: SparkSession, source_dir: str, sink_root: str, checkpoint: str,
                     available_now: bool = True, processing_time: str | None = None,
                     max_files_per_trigger: int | None = None):
    """Heartbeat arrivals (Parquet files of ``seq, received_at, body``) ->
    history, outcomes and versioned latest state."""
    ensure_semantics(spark)
    r = spark.readStream.schema(S.ARRIVAL_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.parquet(source_dir)
    return _start(src, lambda df, bid: process_heartbeat_batch(df, bid, sink_root), checkpoint,
                  available_now, processing_time)


def webhook_stream(spark: SparkSession, source_dir: str, sink_root: str, checkpoint: str, secret: str,
                   available_now: bool = True, processing_time: str | None = None,
                   max_files_per_trigger: int | None = None):
    ensure_semantics(spark)
    r = spark.readStream.schema(S.WEBHOOK_ARRIVAL_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.parquet(source_dir)
    return _start(src, lambda df, bid: process_webhook_batch(df, bid, sink_root, secret), checkpoint,
                  available_now, processing_time)


def rate_stream(spark: SparkSession, source_dir: str, checkpoint: str, sink_path: str,
                window: str = "5 minutes", step: str = "1 minute", watermark: str = "10 minutes",
                secret: str = "", available_now: bool = True):
    """Webhook request rate by code as a streaming windowed aggregate; the
    watermark bounds the window state, results are appended once a window
    can no longer change."""
    ensure_semantics(spark)
    src = spark.readStream.schema(S.WEBHOOK_ARRIVAL_SCHEMA).parquet(source_dir)
    # The grid covers (T - w, T]: shift by 1 µs *before* the watermark so the
    # window groups directly on the watermarked column.
    c = ingest.classify_webhook(src, secret).select(
        (F.col("received_at").cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND")).alias("_t"),
        F.col("code").cast("string").alias("code"))
    c = c.withWatermark("_t", watermark)
    g = c.groupBy(F.window("_t", window, step).alias("_w"), "code").agg(
        F.count(F.lit(1)).alias("_n"))
    secs = metrics._seconds(window)
    agg = g.select(F.col("_w.end").cast("timestamp_ntz").alias("t"), "code",
                   (F.col("_n").cast("double") / secs).alias("rate"))
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()
