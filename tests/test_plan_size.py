"""Plans stay small: a driver holds the text of every plan it runs."""

from __future__ import annotations

import datetime as dt

import pytest

from __spark_entry__ import queries
from fleetline.sources import fixtures as fx

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("plan-size"))
    at = dt.datetime(2024, 1, 5)
    rows = [(n, at + dt.timedelta(minutes=n % 5000), n % 7, "purchase", 1.0, '{"k": 5}') for n in (3, 8, 9, 5008, 5009, 5010)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{d}/events.parquet")
    return d


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_padding_of_large_bodies_is_not_in_the_plans(spark, events):
    """Constant folding made a literal of 1 MiB of it, once for each time a plan read the bodies."""
    assert len(optimized(fx.heartbeat_arrivals(spark, events))) < 50_000
    assert len(optimized(fx.webhook_arrivals(spark, events))) < 50_000
    for name in ("q11_backlog", "a4_backlog_high"):
        assert len(optimized(queries()[name](spark, events))) < 5_000_000


def test_padded_bodies_are_over_the_limit(spark, events):
    beats = {r.seq: r.body for r in fx.heartbeat_arrivals(spark, events).collect()}
    hooks = {r.seq: r.body for r in fx.webhook_arrivals(spark, events).collect()}
    for bodies, padded in ((beats, (8, 5008)), (hooks, (9, 5009))):
        for n, body in bodies.items():
            plain = body.rstrip(" ")
            assert len(body) - len(plain) == ((1 << 20) if n in padded else 0)
            assert plain[-1] == "}"


def test_export_decodes_bodies_once(spark, events, monkeypatch):
    """State, history and what is added after the instant each decoded all bodies again."""
    from fleetline.plans import catalog

    decoded, heartbeats = [], catalog.heartbeats
    monkeypatch.setattr(catalog, "heartbeats", lambda *a, **k: decoded.append(1) or heartbeats(*a, **k))
    got = {r.table: r.rows for r in queries()["k2_export_counts"](spark, events).collect()}
    assert len(decoded) == 1
    # 8 and 5008 are over the limit, 3 has an sn that is too long
    assert got == {"status": 3, "history": 3}
