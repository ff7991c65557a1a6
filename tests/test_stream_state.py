"""State carried between batches: timers, bounded dedup, alerts, rollups.  Any
cut of the input gives the batch result."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetline.operators import alerts, metrics, queue
from fleetline.operators.rollups import RollupStore
from fleetline.operators.rollups import rate as rollup_rate
from fleetline.operators.rollups import rollup, rollup_stream
from fleetline.session import ensure_semantics
from fleetline.sources import fixtures as fx
from fleetline.streaming import AlertRule, AlertStore, alert_stream, dedup, retries
from tests.conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1)
S = retries.SECOND


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def cuts_of(rng, n, parts=4):
    edges = sorted({0, n, *rng.sample(range(n), parts - 1)})
    return list(zip(edges, edges[1:], strict=False))


# timers -----------------------------------------------------------------------------------------------------------

def test_steps_follow_the_writer_policy():
    kept, out = retries.steps(("", 0, 0, 0, 0), [("arrival", 0, None), ("result", 5 * S, "x")], None)
    assert [r[2] for r in out] == ["processing", "queued"] and out[1][4] == 15 * S and kept[0] == "queued"
    kept, out = retries.steps(kept, [], 14 * S)
    assert out == []                                     # not due yet
    kept, out = retries.steps(kept, [], 15 * S)
    assert out == [(15 * S, 2, "processing", 2, None, None)]
    for n, wait in ((2, 20), (3, 40), (4, 80)):
        when = kept[3] + S
        kept, out = retries.steps(kept, [("result", when, "x")], None)
        assert out[0][3] == n and out[0][4] == when + wait * S
        kept, _ = retries.steps(kept, [], out[0][4])
    kept, out = retries.steps(kept, [("result", kept[3] + S, "x")], 10**15)
    assert [(r[2], r[3]) for r in out] == [("dead", 5)]
    assert retries.steps(kept, [("result", 10**14, None)], None)[1] == []     # nothing is processing
    kept, out = retries.steps(kept, [("arrival", 10**14, None)], None)        # re-sent: starts again
    assert out[-1][2:4] == ("processing", 1)


def worker_log(rng, ids=25):
    """Arrivals (some re-sent) and results that come while an id is processing."""
    rows = []
    for i in range(ids):
        kept, when = ("", 0, 0, 0, 0), rng.randrange(100) * S
        n = 0
        for _ in range(rng.randrange(1, 8)):
            kind = "arrival" if n == 0 or rng.random() < 0.15 else "result"
            reason = rng.choice([None, "x", "x", "x"]) if kind == "result" else None
            rows.append((i, kind, when, n, reason))
            kept, _ = retries.steps(kept, [(kind, when, reason)], None)
            n += 1
            when = max(when, kept[2] if kept[0] == "queued" else when) + rng.randrange(1, 9) * S
    return sorted(rows, key=lambda r: (r[2], r[0], r[3]))


@pytest.mark.parametrize("seed, parts", [(2, 4)])
def test_timers_fire_without_a_fold_and_equal_the_replay(spark, tmp_path, seed, parts):
    ensure_semantics(spark)
    rng = random.Random(seed)
    log = worker_log(rng)
    until = max(r[2] for r in log) + 10_000 * S
    src = tmp_path / "in"
    pieces = [(0, len(log))] if parts == 1 else cuts_of(rng, len(log), parts)
    frame = lambda rows: spark.createDataFrame(
        [(i, k, T0 + dt.timedelta(microseconds=us), n, r) for i, k, us, n, r in rows], retries.EVENTS).coalesce(1)
    for n, (a, b) in enumerate(pieces):
        frame(log[a:b]).write.parquet(str(src / f"p{n}"))
    frame([(None, "clock", until, 0, None)]).write.parquet(str(src / "p99"))
    stream = spark.readStream.schema(retries.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    retries.retry_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(300)
    got = sorted((r["id"], (r["at"] - T0) // dt.timedelta(microseconds=1), r["seq"], r["status"], r["attempts"],
                  None if r["next_at"] is None else (r["next_at"] - T0) // dt.timedelta(microseconds=1), r["reason"])
                 for r in spark.read.schema(retries.OUTPUT).parquet(str(tmp_path / "out")).collect())
    want, ends = [], {}
    for i in {r[0] for r in log}:
        kept, out = retries.steps(("", 0, 0, 0, 0), [(k, us, r) for j, k, us, n, r in log if j == i], until)
        want += [(i, *o) for o in out]
        ends[i] = kept
    key = lambda r: (r[0], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[3] == "processing" and r[4] > 1 for r in got)
    # the queue's fold over the same transitions ends in the same states
    arr = spark.createDataFrame([(i * 100 + n, T0 + dt.timedelta(microseconds=us), f"d{i}", T0, "p") for i, k, us, n, _ in log if k == "arrival"],
                                "seq long, received_at timestamp_ntz, sn string, event_ts timestamp_ntz, payload string")
    tr = spark.createDataFrame([(i * 100, T0 + dt.timedelta(microseconds=us), n, s, a, None if x is None else T0 + dt.timedelta(microseconds=x), r)
                                for i, us, n, s, a, x, r in want], retries.OUTPUT)
    folded = {r["id"] // 100: (r["status"], r["attempts"]) for r in queue.fold(arr, tr).collect()}
    assert folded == {i: (k[0], k[1]) for i, k in ends.items()}


def test_ids_of_a_span_share_state(spark, tmp_path):
    """A group of state costs milliseconds whatever it holds: 5,000 ids are a few groups."""
    ensure_semantics(spark)
    n, start = 5_000, retries.SPAN - 7
    ids = [-3, *range(start, start + n)]
    row = lambda i, kind, us, seq, reason=None: (i, kind, T0 + dt.timedelta(microseconds=us), seq, reason)
    arrivals = [row(i, "arrival", 0, 0) for i in ids]
    failed = [row(i, "result", 5 * S, None if i % 2 else 1, "x") for i in ids if i % 3]
    src = tmp_path / "in"
    for k, rows in enumerate([arrivals, failed, [row(None, "clock", 1_000 * S, 0)]]):
        spark.createDataFrame(rows, retries.EVENTS).coalesce(1).write.parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema(retries.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    query = retries.retry_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(300)
    held = [x["stateOperators"][0]["numRowsTotal"] for x in query.recentProgress if x["stateOperators"]]
    assert 0 < max(held) <= n // retries.SPAN + 3
    got = collections.Counter((r["id"], r["seq"], r["status"], r["attempts"]) for r in spark.read.schema(retries.OUTPUT).parquet(str(tmp_path / "out")).collect())
    want = collections.Counter(x for i in ids for x in [(i, 0, "processing", 1)] + ([(i, 1, "queued", 1), (i, 2, "processing", 2)] if i % 3 else []))
    assert got == want


def test_span_steps_fire_as_timers_of_each_id():
    """Ids with rows reach the timers due by now, the others those before now; a
    clock row for an unknown id leaves no state."""
    kept = {i: ("queued", 1, 1_000 * k, 0, 3) for i, k in [(1, 5), (2, 6), (3, 7), (4, 6)]}
    kept[5] = ("done", 1, 0, 0, 2)
    rows = [(4, "clock", 6_000, None), (5, "arrival", 6_000, None), (8, "clock", 6_000, None), (9, "result", 2_000, "x")]
    out = retries.span_steps(kept, rows, 6_000)
    assert sorted((o[0], o[1], o[3], o[4]) for o in out) == [(1, 5_000, "processing", 2), (4, 6_000, "processing", 2), (5, 6_000, "processing", 1)]
    assert {i: k[0] for i, k in kept.items()} == {1: "processing", 2: "queued", 3: "queued", 4: "processing", 5: "processing", 9: ""}
    assert retries.unpacked(retries.packed(kept)) == kept


# bounded dedup ----------------------------------------------------------------------------------------------------

def webhooks(spark, rows):
    return spark.createDataFrame([(s, at(t), '{"sn":"%s","event_ts":"2024-01-01T00:00:00Z"}' % sn, None) for s, t, sn in rows],
                                 "seq long, received_at timestamp_ntz, body string, signature string")


def run_dedup(spark, tmp_path, batches, bound="10 minutes"):
    src = tmp_path / "in"
    for n, rows in enumerate(batches):
        webhooks(spark, rows).coalesce(1).write.parquet(str(src / f"p{n}"))
    q = dedup.dedup_stream(spark, str(src / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), "k", bound, max_files_per_trigger=1)
    q.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out")), dedup.late_rows(q)


def test_resent_inside_the_bound_equals_the_batch(spark, tmp_path):
    batches = [[(1, 0, "a"), (2, 10, "b"), (3, 20, "a")], [(4, 200, "a"), (5, 210, "c"), (6, 215, "A")], [(7, 500, "b"), (8, 505, "d")]]
    out, late = run_dedup(spark, tmp_path, batches)
    batch = dedup.first_of_key(dedup.accepted(webhooks(spark, [r for b in batches for r in b]), "k"))
    assert rows_of(out.select(*batch.columns)) == rows_of(batch)
    assert late == 0 and dedup.past_bound(out).count() == 0


def test_rows_past_the_bound_are_counted(spark, tmp_path):
    batches = [[(1, 0, "a")], [(2, 5000, "b")], [(6, 8000, "c")], [(3, 9000, "a")], [(4, 10, "late")], [(5, 9001, "z")]]
    out, late = run_dedup(spark, tmp_path, batches)
    assert {r["sn"]: r["repeats"] for r in dedup.past_bound(out).collect()} == {"a": 1}   # its bound was over
    assert late == 1 and out.where("sn = 'late'").count() == 0                            # dropped, and counted


# alerts -----------------------------------------------------------------------------------------------------------

def evaluations(rng, n=80, series=("x", "y")):
    rows = []
    for s in series:
        t = 0
        for _ in range(n):
            t += 60 if rng.random() < 0.9 else 60 * rng.randrange(2, 5)
            rows.append((s, at(t), float(rng.random() < 0.35)))
    return sorted(rows, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed, step", [(1, None), (2, 60.0)])
def test_any_cut_gives_the_alerts_of_the_batch(spark, tmp_path, seed, step):
    rng = random.Random(seed)
    rows = evaluations(rng)
    frame = lambda r: spark.createDataFrame(r, "s string, t timestamp_ntz, value double")
    want = alerts.for_duration(frame(rows), ["s"], F.col("value") < 1, 120, ts="t", step_seconds=step)
    rule = AlertRule("r", ["s"], F.col("value") < 1, 120, "t", step)
    store = AlertStore(spark, str(tmp_path), rule)
    for n, (a, b) in enumerate(cuts_of(rng, len(rows))):
        for _ in range(rng.choice([1, 2])):        # a batch that runs again changes nothing
            store.advance(frame(rows[a:b]), n)
    store.advance(frame([]), 99)                   # a quiet batch keeps what is pending
    assert rows_of(store.alerts().select(*want.columns)) == rows_of(want) and want.count() > 3


def test_pending_is_carried_and_old_rows_are_ignored(spark):
    frame = lambda r: spark.createDataFrame(r, "s string, t timestamp_ntz, value double")
    state = spark.createDataFrame([], alerts.alert_state(["s"]))
    step = lambda st, r: alerts.advance(st, frame(r), ["s"], F.col("value") < 1, 100, ts="t")
    done, state = step(state, [("x", at(0), 0.0), ("x", at(60), 0.0)])
    assert done.count() == 0 and [tuple(r) for r in state.collect()] == [("x", at(60), True, at(0), None)]
    done, state = step(state, [("x", at(30), 1.0), ("x", at(120), 0.0)])     # the first one is late
    assert done.count() == 0 and [tuple(r) for r in state.collect()] == [("x", at(120), True, at(0), at(120))]
    assert [tuple(r) for r in alerts.firing(state, ["s"]).collect()] == [("x", at(0), at(120), at(120), None)]
    done, state = step(state, [("x", at(180), None)])                         # no value: the condition is false
    assert [tuple(r) for r in done.collect()] == [("x", at(0), at(120), at(120), at(180))]
    assert [tuple(r) for r in state.collect()] == [("x", at(180), False, None, None)]


def test_alert_stream(spark, tmp_path):
    rows = evaluations(random.Random(9), 40)
    frame = lambda r: spark.createDataFrame(r, "s string, t timestamp_ntz, value double")
    for n, (a, b) in enumerate([(0, 30), (30, 55), (55, 80)]):
        frame(rows[a:b]).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    src = spark.readStream.schema("s string, t timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rule = AlertRule("r", ["s"], F.col("value") < 1, 60, "t", 60.0)
    alert_stream(src, str(tmp_path / "out"), rule, str(tmp_path / "ck")).awaitTermination(300)
    want = alerts.for_duration(frame(rows), ["s"], F.col("value") < 1, 60, ts="t", step_seconds=60.0)
    store = AlertStore(spark, str(tmp_path / "out"), rule)
    assert len(store.state.versions()) == 3 and rows_of(store.alerts().select(*want.columns)) == rows_of(want)


# rollups ----------------------------------------------------------------------------------------------------------

def counter(rng, n=120):
    rows = []
    for code in ("200", "500"):
        value = 0
        for k in range(n):
            value = value + rng.randrange(4) if rng.random() < 0.93 else rng.randrange(3)  # resets
            rows.append((code, at(k * 97 + rng.randrange(60) + 80_000), float(value)))
    return rows


@pytest.mark.parametrize("window, step", [("10 minutes", "5 minutes"), ("15 minutes", "10 minutes"), ("1 hour", "1 hour")])
def test_rates_from_a_rollup_equal_those_from_samples(spark, window, step):
    s = spark.createDataFrame(counter(random.Random(4)), "code string, ts timestamp_ntz, value double")
    want = metrics.rate_from_samples(s, ["code"], ["code"], window=window, step=step)
    got = rollup_rate(rollup(s, ["code"], window, step), ["code"], ["code"], window, step)
    norm = lambda d: {(r["t"], r["code"]): round(r["rate"], 9) for r in d.collect()}
    assert norm(got) == norm(want) and len(norm(want)) > 5


def test_late_rows_correct_their_buckets_and_no_others(spark, tmp_path):
    rng = random.Random(6)
    rows = counter(rng)
    frame = lambda r: spark.createDataFrame(r, "code string, ts timestamp_ntz, value double")
    store = RollupStore(spark, str(tmp_path), ["code"], "10 minutes", "5 minutes", buckets=4)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    store.add(frame(shuffled[:150]), 0)
    store.add(frame(shuffled[150:]), 1)
    store.add(frame(shuffled[150:]), 1)                                   # runs again
    whole = rollup(frame(rows), ["code"], "10 minutes", "5 minutes")
    assert rows_of(store.read().select(*whole.columns)) == rows_of(whole)
    before = set(store.table.files(store.table.manifest()))
    store.add(frame([("200", dt.datetime(2024, 1, 20), 5.0)]), 2)
    assert before < set(store.table.files(store.table.manifest()))        # another day: nothing else is rewritten
    want = metrics.rate_from_samples(frame([*rows, ("200", dt.datetime(2024, 1, 20), 5.0)]), ["code"], ["code"], window="10 minutes", step="5 minutes")
    norm = lambda d: {(r["t"], r["code"]): round(r["rate"], 9) for r in d.collect()}
    assert norm(store.rate(["code"])) == norm(want)                        # the last windows are there


def test_rollup_stream_has_late_rows_and_last_windows(spark, tmp_path):
    s = fx.counter_samples(spark, SF_SMALL)
    days = [s.where(F.dayofmonth("ts") % 3 == k) for k in (2, 0, 1)]
    for n, part in enumerate(days):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    keys = ["metric", "code", "instance"]
    store = RollupStore(spark, str(tmp_path / "store"), keys, "6 hours", "1 hour")
    src = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rollup_stream(src, store, str(tmp_path / "ck")).awaitTermination(300)
    norm = lambda d: {(r["t"], r["code"]): round(r["rate"], 9) for r in d.collect()}
    assert norm(store.rate(["code"])) == norm(metrics.rate_from_samples(s, keys, ["code"], window="6 hours", step="1 hour"))


def test_rows_of_one_id_are_ordered_without_a_frame_per_id():
    import pandas as pd

    from fleetline.streaming.retries import _frame, _ordered

    a = pd.DataFrame({"kind": ["result", "result"], "at_us": [20, 10], "seq": [2.0, float("nan")], "reason": ["timeout", None]})
    b = pd.DataFrame({"kind": ["arrival"], "at_us": [10], "seq": [1.0], "reason": [None]})
    assert _ordered(iter([a, b])) == [("arrival", 10, None), ("result", 10, None), ("result", 20, "timeout")]
    out = _frame(7, [(1_000_000, 0, "processing", 1, None, None), (2_000_000, 1, "queued", 1, 12_000_000, "timeout")])
    assert out["at"].tolist() == [pd.Timestamp(1, unit="s"), pd.Timestamp(2, unit="s")]
    assert pd.isna(out["next_at"][0]) and out["next_at"][1] == pd.Timestamp(12, unit="s")
    assert out["reason"].tolist() == [None, "timeout"] and out["attempts"].tolist() == [1, 1]
