"""Plans that keep their state in stored tables: each cuts the inputs into
batches, writes them one by one under a scratch folder of the session's
checkpoint folder, and returns what the stored tables then hold.  The result is
that of the batch plan, which is what the DuckDB twin checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.operators import ingest, logs, queue, snapshots, state
from fleetline.operators.rollups import RollupStore
from fleetline.plans import catalog
from fleetline.plans.catalog import AS_OF, RULE_SECONDS, STEP, WIN, plan
from fleetline.session import scratch_folder
from fleetline.sources import feeds
from fleetline.sources import fixtures as fx
from fleetline.streaming import (AlertRule, AlertStore, QueueStore, current_status, dedup, drain_batch, heartbeat_stream,
                                 merge_status, process_webhook_batch, retries, status_store, webhook_stream)

# Times at which inputs are cut into batches.
CUTS = ("2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-24 00:00:00")

BUCKETS = 4  # a bucket is meant to hold some hundred MB


def batches(rows: DataFrame, ts: str = "received_at") -> list[DataFrame]:
    """The rows before, between and after the cuts."""
    at = F.col(ts)
    times = [F.lit(c).cast("timestamp_ntz") for c in CUTS]
    return [rows.where(at < times[0]), *[rows.where((at >= a) & (at < b)) for a, b in zip(times, times[1:], strict=False)],
            rows.where(at >= times[-1])]


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly by arrival.  Decoding costs far more than reading, and
    a scan cut by bytes has few splits: most cores would be idle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq")


# ---------------------------------------------------------------- sources
@plan("s1_arrival_files")
def s1_arrival_files(spark, sf_dir):
    """Webhook arrivals as JSON record files, read with a fixed schema."""
    path = scratch_folder(spark, "arrivals")
    w = fx.webhook_arrivals(spark, sf_dir)
    w.where(F.octet_length("body") < ingest.MAX_BODY_BYTES).drop("fault").withColumn(
        "received_at", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(path)
    return ingest.classify_webhook(feeds.read_arrivals(spark, path, webhooks=True, fmt="json"), fx.FIXTURE_SECRET).select("seq", "code", "reason", "sn", "event_ts")


@plan("s2_webhook_stream")
def s2_webhook_stream(spark, sf_dir):
    """The same arrivals as a file stream through the webhook stream."""
    root = scratch_folder(spark, "webhooks")
    for n, part in enumerate(batches(fx.webhook_arrivals(spark, sf_dir).drop("fault"))):
        part.write.parquet(f"{root}/in/part={n}")
    webhook_stream(spark, f"{root}/in/*", f"{root}/out", f"{root}/checkpoint", fx.FIXTURE_SECRET, max_files_per_trigger=64).awaitTermination()
    return spark.read.parquet(f"{root}/out/webhook_outcomes").select("seq", "code", "reason", "sn", "event_ts")


@plan("s2_heartbeat_stream")
def s2_heartbeat_stream(spark, sf_dir):
    """Heartbeat arrivals as a file stream: outcomes after history conflicts."""
    root = scratch_folder(spark, "heartbeats")
    fx.heartbeat_arrivals(spark, sf_dir, collisions=True).write.parquet(f"{root}/in")
    heartbeat_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out/outcomes").select("seq", "code", "reason")


@plan("s5_container_log_files")
def s5_container_log_files(spark, sf_dir):
    """Container log lines written as runtime log files and read back: time,
    stream, tag and message are split again."""
    path = scratch_folder(spark, "containers")
    lines = fx.container_logs(spark, sf_dir)
    lines.select(F.concat(F.date_format("ts", fx.RFC3339_US), F.lit(" stdout F "), "line")).write.text(path)
    return feeds.read_container_logs(spark, f"{path}/*.txt").select("ts", "line")


# ---------------------------------------------------------------- state
@plan("h4_stored_state")
def h4_stored_state(spark, sf_dir):
    """Latest state kept in a bucketed table: four batches, each rewriting the
    buckets of its own devices."""
    root = scratch_folder(spark, "status")
    for n, part in enumerate(batches(fx.heartbeat_arrivals(spark, sf_dir))):
        merge_status(status_store(spark, root, BUCKETS), ingest.classify_heartbeat(dealt(part)), n)
    return current_status(spark, root, BUCKETS).drop("received_at", "seq", "first_seq")


# ---------------------------------------------------------------- queue
def stored_queue(spark, sf_dir) -> QueueStore:
    """The queue as stored tables, filled batch by batch, then with all the
    writer has done."""
    store = QueueStore(spark, scratch_folder(spark, "queue"), BUCKETS)
    for n, part in enumerate(batches(fx.webhook_arrivals(spark, sf_dir))):
        store.enqueue(queue.arrivals_from(ingest.classify_webhook(part, fx.FIXTURE_SECRET)), n)
    _, tr = catalog.queue_logs(spark, sf_dir)
    store.apply(tr, "writer", 0)
    return store


@plan("q8_open_store")
def q8_open_store(spark, sf_dir):
    """One writer tick over the open events of the stored queue."""
    return stored_queue(spark, sf_dir).tick(AS_OF, 50)


@plan("q_stored_queue")
def q_stored_queue(spark, sf_dir):
    """The stored queue after a tick: open and finished events together."""
    store = stored_queue(spark, sf_dir)
    store.apply(store.tick(AS_OF, 50), "ticks", 0)
    store.compact(2)
    return store.table()


@plan("m7_writer_runs")
def m7_writer_runs(spark, sf_dir):
    """Three ticks of the writer over the webhooks of the whole table: runs, and
    events drained as counted while the transitions were written."""
    root = scratch_folder(spark, "writer")
    process_webhook_batch(fx.webhook_arrivals(spark, sf_dir), 0, root, fx.FIXTURE_SECRET)
    for n in range(3):
        drain_batch(spark, root, AS_OF, n, 40)
    return queue.writer_runs(spark.read.parquet(f"{root}/ticks"))


@plan("q5_retry_stream")
def q5_retry_stream(spark, sf_dir):
    """Retries driven by timers of keyed streaming state over arrivals, worker
    results and clock rows: the transitions, without a fold."""
    root = scratch_folder(spark, "retries")
    # made once: every cut of them would decode and key all webhooks again
    fx.worker_events(queue.keyed_arrivals(catalog.queue_arrivals(spark, sf_dir))).write.parquet(f"{root}/events")
    events = spark.read.parquet(f"{root}/events")
    for n, part in enumerate(batches(events, "at")):
        part.write.parquet(f"{root}/in/part={n}")
    spark.createDataFrame([(None, "clock", None, 0, None)], retries.EVENTS).withColumn(
        "at", F.lit("2024-02-02 00:00:00").cast("timestamp_ntz")).write.parquet(f"{root}/in/part=9")
    stream = spark.readStream.schema(retries.EVENTS).parquet(f"{root}/in/*")
    retries.retry_stream(stream, f"{root}/out", f"{root}/checkpoint", delay="1 hour").awaitTermination()
    return spark.read.schema(retries.OUTPUT).parquet(f"{root}/out")


@plan("q1_resent_within_bound")
def q1_resent_within_bound(spark, sf_dir):
    """Every accepted webhook delivered twice, 20 minutes apart: the stream keeps
    the first delivery of each key of the bound."""
    root = scratch_folder(spark, "resent")
    w = fx.webhook_arrivals(spark, sf_dir).drop("fault")
    again = w.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 20 MINUTES")).withColumn("seq", F.col("seq") + F.lit(10**9))
    for n, part in enumerate(batches(w.unionByName(again))):
        part.write.parquet(f"{root}/in/part={n}")
    dedup.dedup_stream(spark, f"{root}/in/*", f"{root}/out", f"{root}/checkpoint", fx.FIXTURE_SECRET, bound="60 days").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("sn", "event_ts").agg(F.count(F.lit(1)).alias("kept"))


# ---------------------------------------------------------------- windows and alerts
@plan("w1_stored_rollup")
def w1_stored_rollup(spark, sf_dir):
    """w1 from the stored rollup: the batches come in the wrong order, so most
    samples are late."""
    store = RollupStore(spark, scratch_folder(spark, "rollup"), ["metric", "code", "instance"], WIN, STEP, BUCKETS)
    parts = batches(fx.counter_samples(spark, sf_dir), "ts")
    for n, part in enumerate([parts[2], parts[0], parts[3], parts[1]]):
        store.add(part, n)
    return store.rate(["code"], end=AS_OF)


@plan("a1_carried_alerts")
def a1_carried_alerts(spark, sf_dir):
    """a1 with pending and firing alerts carried over four batches."""
    rule = AlertRule("service-down", ["namespace", "deployment"], F.col("value") < 1, 60, "t", RULE_SECONDS)
    store = AlertStore(spark, scratch_folder(spark, "alerts"), rule)
    for n, part in enumerate(batches(catalog.replicas_evaluated(spark, sf_dir), "t")):
        store.advance(part, n)
    return store.alerts()


# ---------------------------------------------------------------- logs and snapshots
@plan("l5_indexed_search")
def l5_indexed_search(spark, sf_dir):
    """l5 over the stored daily index with its bloom filters."""
    root = scratch_folder(spark, "logs")
    logs.write_index(catalog.log_table(spark, sf_dir).drop("fields"), root)
    return logs.search_index(spark, root, "CPE-00001", AS_OF, 3 * 24 * 60).select("ts", "pod", "message")


def exported(spark, sf_dir) -> tuple[str, str]:
    """State and history written as files, pinned at one instant, exported."""
    root = scratch_folder(spark, "export")
    paths = {"status": f"{root}/live/status", "history": f"{root}/live/history"}
    # decoding costs most by far: the bodies are decoded once, and all tables made from the outcomes
    catalog.heartbeats(spark, sf_dir).select("seq", "received_at", "code", "sn", *state.STATUS_FIELDS).write.parquet(f"{root}/outcomes")
    decoded = spark.read.parquet(f"{root}/outcomes")
    state.latest_state(decoded).write.parquet(paths["status"])
    state.history(decoded).write.parquet(paths["history"])
    pins = snapshots.pinned(spark, paths, "2999-01-01T00:00:00")
    # what is added after the instant is in no table of the snapshot
    state.latest_state(decoded).limit(5).write.mode("append").parquet(paths["status"])
    snapshots.export(pins, f"{root}/backups", "2024-01-31T23:30:00")
    return f"{root}/backups", "2024-02-01"


@plan("k1_k5_restored_status")
def k1_k5_restored_status(spark, sf_dir):
    """Latest state after export and restore."""
    root, date = exported(spark, sf_dir)
    return snapshots.restore(spark, root, date, ["status"], register=False)["status"]


@plan("k2_export_counts")
def k2_export_counts(spark, sf_dir):
    """Rows per exported table, as counted while they were written."""
    return snapshots.counts(spark, *exported(spark, sf_dir))
