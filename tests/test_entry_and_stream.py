import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tools.check_oracle import digest


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_plan_matches_duckdb_at_sf0001(spark):
    import __spark_entry__ as E
    from fleetline.sources.tables import TABLES, table_path
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    sqls = E.oracle_sql()
    bad = []
    for name, fn in sorted(E.queries().items()):
        df = fn(spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
        if name not in sqls:
            continue
        res = con.execute(sqls[name])
        cols = [d[0] for d in res.description]
        if sorted(cols) != sorted(df.columns) or digest(df.columns, rows)[0] != digest(cols, res.fetchall())[0]:
            bad.append(name)
    assert bad == []


@pytest.mark.parametrize("collisions", [False, True])
def test_stream_equals_batch(spark, tmp_path, collisions):
    """Heartbeats streamed in several micro-batches give the same latest
    state and history as one batch over all arrivals (with collisions, a
    history key first seen in one batch rejects its repeats in later ones)."""
    from fleetline.operators import ingest, state
    from fleetline.sources import fixtures as fx
    from fleetline.streaming import current_status, heartbeat_stream, status_store

    arr = fx.heartbeat_arrivals(spark, SF_SMALL, collisions).toPandas()
    src = tmp_path / "src"
    src.mkdir()
    # Micro-batches follow arrival order, as a feed delivers them: the
    # first arrival processed for a history key is also the lowest seq.
    arr = arr.sort_values("seq")
    n = len(arr)
    for i, part in enumerate([arr.iloc[j * n // 4:(j + 1) * n // 4] for j in range(4)]):
        spark.createDataFrame(part, "seq long, received_at timestamp_ntz, body string") \
            .coalesce(1).write.parquet(str(src / f"part{i}"))
    sink = str(tmp_path / "sink")
    q = heartbeat_stream(spark, str(src / "*"), sink, str(tmp_path / "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(600)
    got = current_status(spark, sink).drop("received_at", "seq", "first_seq")
    want = state.latest_state(ingest.classify_heartbeat(fx.heartbeat_arrivals(spark, SF_SMALL, collisions)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    store = status_store(spark, sink)
    assert len(store.versions()) == 4 and store.unreferenced(keep=2)   # one version a batch; old buckets may go
    hist = spark.read.parquet(f"{sink}/history").drop("device", "batch_id", "event_date")
    want_h = state.history(ingest.classify_heartbeat(fx.heartbeat_arrivals(spark, SF_SMALL, collisions)))
    assert sorted(map(tuple, hist.select(*want_h.columns).collect())) == sorted(map(tuple, want_h.collect()))
    got_o = spark.read.parquet(f"{sink}/outcomes").select("seq", "code", "reason")
    want_o = state.heartbeat_outcomes(ingest.classify_heartbeat(fx.heartbeat_arrivals(spark, SF_SMALL, collisions)))
    assert sorted(map(tuple, got_o.collect())) == sorted(map(tuple, want_o.select("seq", "code", "reason").collect()))
    if collisions:
        assert got_o.where("code = 500").count() > 0


def test_key_taken_by_an_earlier_batch_is_a_conflict(spark, tmp_path):
    from fleetline.streaming.streams import process_heartbeat_batch

    def batch(seq, sn):
        return spark.createDataFrame([(seq, "2024-01-01 00:00:00", f'{{"sn":"{sn}"}}')], "seq long, at string, body string").select(
            "seq", F.col("at").cast("timestamp_ntz").alias("received_at"), "body")

    sink = str(tmp_path)
    process_heartbeat_batch(batch(1, "A"), 0, sink)
    for _ in range(2):  # the second time is a re-run
        process_heartbeat_batch(batch(2, "a"), 1, sink)
    out = sorted(tuple(r) for r in spark.read.parquet(f"{sink}/outcomes").select("seq", "code", "reason").collect())
    assert out == [(1, 202, None), (2, 500, "history_conflict")]
    assert spark.read.parquet(f"{sink}/history").count() == 1


def test_rerun_of_a_batch_with_an_empty_result_leaves_nothing(spark, tmp_path):
    from fleetline.streaming.parts import write_partition

    path = str(tmp_path / "out")
    write_partition(spark.range(3), path, 0)
    write_partition(spark.range(2), path, 1)
    write_partition(spark.range(0), path, 0)
    assert spark.read.parquet(path).select("batch_id").distinct().collect()[0][0] == 1
    assert spark.read.parquet(path).count() == 2


def test_webhook_stream_then_drain_ticks(spark, tmp_path):
    """Webhooks streamed into the arrivals log, then three writer ticks of 40:
    each tick drains the lowest ready ids, none twice, re-running a tick
    changes nothing."""
    from fleetline.sources import fixtures as fx
    from fleetline.streaming import drain_batch, webhook_stream

    w = fx.webhook_arrivals(spark, SF_SMALL).drop("fault")
    src = tmp_path / "wh"
    w.coalesce(2).write.parquet(str(src / "p0"))
    sink = str(tmp_path / "sink")
    q = webhook_stream(spark, str(src / "*"), sink, str(tmp_path / "ck"), fx.FIXTURE_SECRET)
    q.awaitTermination(600)
    accepted = spark.read.parquet(f"{sink}/queue_arrivals").count()
    assert accepted == spark.read.parquet(f"{sink}/webhook_outcomes").where("code = 202").count() > 0
    from fleetline.streaming import QueueStore
    done = []
    for b, t in enumerate(["2024-02-01 00:00:00", "2024-02-01 00:00:01", "2024-02-01 00:00:02"]):
        out = drain_batch(spark, sink, t, b, 40)
        done += [r["id"] for r in out.where("status = 'done'").collect()]
        if b == 0:
            QueueStore(spark, f"{sink}/queue").compact(0)
    drain_batch(spark, sink, "2024-02-01 00:00:02", 2, 40)  # re-run of tick 2
    assert len(done) == len(set(done)) == 120
    ready_order = [r["id"] for r in spark.read.parquet(f"{sink}/queue_arrivals")
                   .groupBy(F.lower("sn"), "event_ts").agg(F.min("seq").alias("id"))
                   .orderBy("id").limit(120).collect()]
    assert sorted(done) == ready_order
    trans = spark.read.parquet(f"{sink}/transitions")
    assert trans.where("status = 'done'").count() == 120
    assert spark.read.parquet(f"{sink}/ticks").count() == 3


def test_drain_stream_drains_by_the_clock(spark, tmp_path):
    """The writer loop: ticks of the machine's clock drain the ready events, each once."""
    import time

    from fleetline.operators import queue
    from fleetline.streaming import QueueStore, drain_stream

    sink = str(tmp_path / "sink")
    arr = spark.range(25).select(F.col("id").alias("seq"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("received_at"),
                                 F.concat(F.lit("d"), "id").alias("sn"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("event_ts"), F.lit("{}").alias("payload"))
    store = QueueStore(spark, f"{sink}/queue")
    store.enqueue(arr, 0)
    q = drain_stream(spark, sink, str(tmp_path / "ck"), limit=20, compact_every=1)
    until = time.time() + 120
    while store.open_events().count() and time.time() < until and q.isActive:
        time.sleep(1)
    q.stop()
    assert q.exception() is None and store.open_events().count() == 0
    done = [r["id"] for r in spark.read.parquet(f"{sink}/transitions").where("status = 'done'").collect()]
    assert sorted(done) == list(range(25))
    runs = queue.writer_runs(spark.read.parquet(f"{sink}/ticks")).first()
    assert runs["writer_runs_total"] >= 2 and runs["drained_total"] == 25


def test_container_log_files(spark, tmp_path):
    from fleetline.sources.feeds import read_container_logs
    d = tmp_path / "containers"
    d.mkdir()
    (d / "api-0_fleet_api-0abc.log").write_text(
        "2024-01-01T00:00:01.5Z stdout F heartbeat updated: sn=CPE-1 wan_ip= sw_version= cpu=0 mem=0\n"
        "not a cri line\n")
    rows = read_container_logs(spark, str(d / "*.log")).collect()
    assert len(rows) == 2
    assert rows[0]["path"].endswith("api-0_fleet_api-0abc.log")
    got = {r["line"]: r["ts"] for r in rows}
    assert got["heartbeat updated: sn=CPE-1 wan_ip= sw_version= cpu=0 mem=0"] is not None
    assert got["not a cri line"] is None


def test_rate_stream_matches_batch(spark, tmp_path):
    """Windows the watermark has closed equal the batch rates."""
    from fleetline.operators import ingest, metrics
    from fleetline.sources import fixtures as fx
    from fleetline.streaming import rate_stream

    w = fx.webhook_arrivals(spark, SF_SMALL).drop("fault")
    src = tmp_path / "wh"
    w.coalesce(1).write.parquet(str(src / "p0"))
    out = str(tmp_path / "rates")
    q = rate_stream(spark, str(src / "*"), str(tmp_path / "ck"), out, window="6 hours",
                    step="1 hour", watermark="1 hour", secret=fx.FIXTURE_SECRET)
    q.awaitTermination(600)
    got = {(r["t"], r["code"]): r["rate"] for r in spark.read.parquet(out).collect()}
    c = ingest.classify_webhook(w, fx.FIXTURE_SECRET).select(
        "received_at", F.col("code").cast("string").alias("code"))
    want = {(r["t"], r["code"]): r["rate"]
            for r in metrics.rate_from_events(c, "received_at", ["code"], "6 hours", "1 hour").collect()}
    assert got and all(want[k] == v for k, v in got.items())
