import datetime as dt

from pyspark.sql import functions as F

from fleetline.operators import ingest, queue, reads, state

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def hb(spark, rows):
    df = spark.createDataFrame([(i + 1, T0 + dt.timedelta(seconds=s), b) for i, (s, b) in enumerate(rows)],
                               "seq long, received_at timestamp_ntz, body string")
    return ingest.classify_heartbeat(df)


def test_upsert_semantics(spark):
    c = hb(spark, [(0, '{"sn":"CPE-A","cpu_pct":10,"last_seen":"2024-01-01T11:00:00Z"}'),
                   (1, '{"sn":"cpe-a","last_seen":"2024-01-01T09:00:00Z"}')])
    rows = state.latest_state(c).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["sn"] == "CPE-A" and r["cpu_pct"] is None
    assert r["last_seen"] == dt.datetime(2024, 1, 1, 9)
    from fleetline.operators import metrics
    g = metrics.gauge_last(c.where(F.col("code").isin(202, 500)), "sn", ["cpu_pct"]).collect()
    assert {x["sn"]: x["cpu_pct"] for x in g} == {"CPE-A": 10, "cpe-a": None}


def test_history_collision_same_ms(spark):
    df = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 1, 0, 0, 0, 123400), '{"sn":"a","cpu_pct":1}'),
        (2, dt.datetime(2024, 1, 1, 0, 0, 0, 123499), '{"sn":"A","cpu_pct":2}')],
        "seq long, received_at timestamp_ntz, body string")
    c = ingest.classify_heartbeat(df)
    h = state.history(c).collect()
    assert len(h) == 1 and h[0]["cpu_pct"] == 1 and h[0]["sn"] == "a"
    assert state.latest_state(c).first()["cpu_pct"] == 2
    codes = {r["seq"]: r["code"] for r in state.heartbeat_outcomes(c).collect()}
    assert codes == {1: 202, 2: 500}


def test_merge_equals_full_fold(spark):
    rows = [(i, '{"sn":"d%d","cpu_pct":%d}' % (i % 3, i)) for i in range(20)]
    c = hb(spark, rows)
    full = sorted(tuple(r) for r in state.latest_state(c).collect())
    for cut in (0, 7, 19):
        prev = state.latest_state(c.where(F.col("seq") <= cut), keep_order_columns=True)
        merged = state.merge_state(prev, c.where(F.col("seq") > cut), keep_order_columns=False)
        assert sorted(tuple(r) for r in merged.collect()) == full


def arrivals(spark, rows):
    return spark.createDataFrame(
        rows, "seq long, received_at timestamp_ntz, sn string, event_ts timestamp_ntz, payload string")


def transitions(spark, rows):
    return spark.createDataFrame(
        rows, "id long, at timestamp_ntz, seq long, status string, attempts int, next_at timestamp_ntz, reason string")


def test_resend_of_done_requeues(spark):
    e = T0
    a = arrivals(spark, [(10, T0, "CPE-1", e, "p1"), (30, T0 + dt.timedelta(minutes=5), "cpe-1", e, "p2")])
    t = transitions(spark, [(10, T0 + dt.timedelta(minutes=1), 0, "processing", 1, None, None),
                            (10, T0 + dt.timedelta(minutes=2), 1, "done", 1, None, None)])
    q = queue.fold(a, t).collect()
    assert len(q) == 1
    r = q[0]
    assert (r["id"], r["sn"], r["status"], r["attempts"], r["payload"]) == (10, "CPE-1", "queued", 0, "p2")


def test_claim_ready_and_drain(spark):
    a = arrivals(spark, [(i, T0, f"s{i}", T0, "p") for i in range(1, 6)])
    q = queue.fold(a)
    assert queue.ready(q, T0, 0).count() == 5           # limit 0 -> 50; next_at == now is ready
    assert queue.ready(q, T0 - dt.timedelta(seconds=1), 50).count() == 0
    claims = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    c = queue.claim(q, claims, T0).collect()
    assert sorted(r["id"] for r in c) == [1, 2] and all(r["attempts"] == 1 for r in c)
    q2 = queue.fold(a, queue.claim(q, claims, T0))
    again = queue.claim(q2, claims, T0 + dt.timedelta(seconds=1)).count()
    assert again == 0                                    # no longer queued: skipped
    d = queue.drain(q, T0, 2).collect()
    assert sorted((r["id"], r["status"]) for r in d) == [(1, "done"), (1, "processing"),
                                                         (2, "done"), (2, "processing")]


def test_complete_is_unconditional(spark):
    a = arrivals(spark, [(1, T0, "s1", T0, "p")])
    q = queue.fold(a)
    claimed = queue.claim(q, spark.createDataFrame([(1,)], "id long"), T0)
    done = queue.complete(claimed, T0 + dt.timedelta(seconds=1))
    r = queue.fold(a, claimed.unionByName(done)).first()
    assert (r["status"], r["attempts"]) == ("done", 1)
    again = queue.complete(claimed, T0 + dt.timedelta(seconds=2))   # no state check
    assert queue.fold(a, claimed.unionByName(done).unionByName(again)).first()["status"] == "done"


def test_failure_policies(spark):
    a = arrivals(spark, [(i, T0, f"s{i}", T0, "p") for i in range(1, 6)])
    t = transitions(spark, [(i, T0, 0, "processing", i, None, None) for i in range(1, 6)])
    q = queue.fold(a, t)
    f = spark.createDataFrame([(i, "boom") for i in range(1, 6)], "id long, reason string")
    w = {r["id"]: r for r in queue.fail(q, f, T0, policy="writer").collect()}
    assert [(w[i]["next_at"] - T0).total_seconds() for i in range(1, 5)] == [10, 20, 40, 80]
    assert w[5]["status"] == "dead" and w[5]["next_at"] is None
    p = {r["id"]: r for r in queue.fail(q, f, T0, policy="queue", base=3).collect()}
    assert [(p[i]["next_at"] - T0).total_seconds() for i in range(1, 4)] == [6, 12, 24]
    assert p[4]["status"] == "dead" and p[4]["attempts"] == 5


def test_paging(spark):
    c = hb(spark, [(i, '{"sn":"d%03d"}' % i) for i in range(30)])
    s = state.latest_state(c)
    assert [r["sn"] for r in reads.page(s, 5, 3).collect()] == ["d005", "d006", "d007"]
    assert reads.page(s, 100, 10).count() == 0
    assert reads.page(s, -1, 501).count() == 30
    assert [r["sn"] for r in reads.page_after(s, "D004", 2).collect()] == ["d005", "d006"]


def test_incremental_fold_equals_full(spark):
    from fleetline.plans import catalog
    from tests.conftest import SF_SMALL
    arr, tr = catalog.queue_logs(spark, SF_SMALL)
    full = sorted(map(tuple, queue.fold(arr, tr).collect()))
    for cut in ("2024-01-08 00:00:00", "2024-01-20 13:00:00"):
        c = F.lit(cut).cast("timestamp_ntz")
        prev = queue.fold(arr.where(F.col("received_at") < c), tr.where(F.col("at") < c),
                          keep_order_columns=True)
        prev = spark.createDataFrame(prev.collect(), prev.schema)   # as if read back from storage
        inc = queue.fold(arr.where(F.col("received_at") >= c), tr.where(F.col("at") >= c), prev=prev)
        assert sorted(map(tuple, inc.collect())) == full
