"""Invariants over the derived fixtures."""

from pyspark.sql import functions as F

from fleetline.operators import ingest, queue, state
from fleetline.plans import catalog
from fleetline.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_one_outcome_per_arrival(spark):
    for arr, classify in ((fx.heartbeat_arrivals(spark, SF_SMALL, collisions=True), ingest.classify_heartbeat),
                          (fx.webhook_arrivals(spark, SF_SMALL),
                           lambda d: ingest.classify_webhook(d, fx.FIXTURE_SECRET))):
        out = classify(arr)
        assert out.count() == arr.count()
        assert out.select("seq").distinct().count() == arr.count()
        assert out.where(F.col("code").isNull()).count() == 0


def test_redelivery_changes_nothing(spark):
    arr, tr = catalog.queue_logs(spark, SF_SMALL)
    once = sorted(map(tuple, queue.fold(arr, tr).collect()))
    twice = sorted(map(tuple, queue.fold(arr.unionByName(arr), tr.unionByName(tr)).collect()))
    assert once == twice
    hb = catalog.heartbeats(spark, SF_SMALL)
    assert sorted(map(tuple, state.latest_state(hb.unionByName(hb)).collect())) == \
        sorted(map(tuple, state.latest_state(hb).collect()))


def test_history_key_unique_and_status_is_last_arrival(spark):
    hb = catalog.heartbeats(spark, SF_SMALL, collisions=True)
    h = state.history(hb)
    assert h.count() == h.select(F.lower("sn"), "event_ts").distinct().count()
    st = {r["sn"].lower(): r for r in state.latest_state(hb).collect()}
    last = (hb.where("code = 202").groupBy(F.lower("sn").alias("k"))
            .agg(F.max_by("wan_ip", "seq").alias("wan_ip")).collect())
    assert all(st[r["k"]]["wan_ip"] == r["wan_ip"] for r in last)


def test_attempts_bounded(spark):
    q = catalog.queue_table(spark, SF_SMALL)
    assert q.where(F.col("attempts") > queue.MAX_ATTEMPTS).count() == 0
    assert q.where((F.col("status") == "dead") & (F.col("attempts") < queue.MAX_ATTEMPTS)).count() == 0
