import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetline.operators import alerts, metrics
from fleetline.operators.series import neighbors, running_count

T0 = dt.datetime(2024, 1, 1)


def test_neighbors_match_plain_window(spark):
    rnd = random.Random(7)
    rows = [(f"s{rnd.randrange(3)}", T0 + dt.timedelta(seconds=rnd.randrange(100000)), float(i))
            for i in range(300)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double").dropDuplicates(["s", "ts"])
    got = neighbors(df, ["s"], "ts", ["v"], split_seconds=3600, want_next=True)
    w = Window.partitionBy("s").orderBy("ts")
    want = df.select("s", "ts", F.lag("v").over(w).alias("pv"), F.lead("ts").over(w).alias("nt"))
    a = sorted((r["s"], r["ts"], r["prev_v"], r["next_ts"]) for r in got.collect())
    b = sorted((r["s"], r["ts"], r["pv"], r["nt"]) for r in want.collect())
    assert a == b
    rc = running_count(df, ["s"], "ts", split_seconds=600).collect()
    rn = df.select("s", "ts", F.row_number().over(w).alias("n")).collect()
    assert sorted((r["s"], r["ts"], r["running_count"]) for r in rc) == sorted(tuple(r) for r in rn)


def samples(spark, pts):
    return spark.createDataFrame([("c", T0 + dt.timedelta(seconds=s), float(v)) for s, v in pts],
                                 "series string, ts timestamp_ntz, value double")


def test_rate_edges(spark):
    one = samples(spark, [(0, 5)])
    assert metrics.increase_from_samples(one, ["series"], [], window="5 minutes", step="1 minute").count() == 0
    reset = samples(spark, [(0, 10), (30, 3)])
    r = metrics.increase_from_samples(reset, ["series"], [], window="5 minutes", step="1 minute")
    assert {row["increase"] for row in r.collect()} == {3.0}
    ev = spark.createDataFrame([(T0 + dt.timedelta(minutes=5),), (T0,)], "ts timestamp_ntz")
    inc = {r["t"]: r["increase"] for r in metrics.increase_from_events(ev, "ts", [], "5 minutes", "5 minutes").collect()}
    # window (T-5m, T]: the sample at T is in, the one at T-5m is not
    assert inc == {T0 + dt.timedelta(minutes=5): 1.0, T0: 1.0}


def fire(spark, pts, for_s, split=86400):
    s = samples(spark, pts)
    return alerts.for_duration(s, ["series"], F.col("value") > 0, for_s, split_seconds=split).collect()


def test_alert_for_duration(spark):
    assert fire(spark, [(0, 1), (59, 1), (70, 0)], 60) == []
    r = fire(spark, [(0, 1), (60, 1), (70, 0)], 60)
    assert len(r) == 1 and r[0]["fired_at"] == T0 + dt.timedelta(seconds=60)
    assert r[0]["resolved_at"] == T0 + dt.timedelta(seconds=70)
    assert fire(spark, [(0, 1), (30, 0), (50, 1), (100, 1)], 60) == []
    pts = [(i * 15, 1 if (i // 7) % 2 == 0 else 0) for i in range(400)]
    assert sorted(map(tuple, fire(spark, pts, 60))) == sorted(map(tuple, fire(spark, pts, 60, split=120)))


def brute_force_alerts(pts, for_s):
    """Row-by-row state machine over one series."""
    out, start, fired, last = [], None, None, None
    for i, (t, v) in enumerate(pts):
        if v > 0:
            if start is None:
                start, fired = t, None
            if fired is None and t - start >= for_s:
                fired = t
            last = t
        else:
            if start is not None and fired is not None:
                out.append((start, fired, last, t))
            start, fired = None, None
    if start is not None and fired is not None:
        out.append((start, fired, last, None))
    return out


def test_alerts_random_against_state_machine(spark):
    rnd = random.Random(11)
    t, pts = 0, []
    for _ in range(600):
        t += rnd.choice([5, 15, 15, 30, 400])
        pts.append((t, 1 if rnd.random() < 0.6 else 0))
    want = brute_force_alerts(pts, 60)
    for split in (60, 900, 86400):
        got = fire(spark, pts, 60, split=split)
        sec = lambda x: None if x is None else int((x - T0).total_seconds())
        assert sorted((sec(r["pending_at"]), sec(r["fired_at"]), sec(r["last_true_at"]),
                       sec(r["resolved_at"])) for r in got) == sorted(want)


def test_missing_evaluation_resets_an_alert(spark):
    s = samples(spark, [(0, 1), (9 * 3600, 1)])
    rule = lambda step: alerts.for_duration(s, ["series"], F.col("value") > 0, 600, step_seconds=step).collect()
    assert rule(300.0) == [] and len(rule(None)) == 1
    grid = samples(spark, [(i * 300, 1) for i in range(5)] + [(i * 300, 1) for i in range(20, 25)])
    for split in (600, 86400):
        got = sorted(alerts.for_duration(grid, ["series"], F.col("value") > 0, 600, split_seconds=split, step_seconds=300.0).collect())
        at = lambda i: T0 + dt.timedelta(seconds=300 * i)
        assert [(r["pending_at"], r["fired_at"], r["resolved_at"]) for r in got] == [(at(0), at(2), at(5)), (at(20), at(22), None)]


def test_equal_times_do_not_depend_on_row_order(spark):
    pts = [(0, 1), (480, 0), (480, 1), (900, 1), (900, 0)]
    out = [fire(spark, p, 60) for p in (pts, pts[::-1], [pts[2], pts[4], pts[0], pts[3], pts[1]])]
    assert out[0] == out[1] == out[2]
    c = [(0, 3), (60, 5), (60, 9), (120, 11)]
    inc = [sorted(tuple(r) for r in metrics.counter_deltas(samples(spark, p), ["series"]).select("ts", "delta").collect()) for p in (c, c[::-1])]
    assert inc[0] == inc[1] and [d for _, d in inc[0]] == [None, 6.0, 2.0]


def test_zero_windows_and_range(spark):
    ev = spark.createDataFrame([(T0 + dt.timedelta(minutes=m),) for m in (1, 2, 31)], "ts timestamp_ntz")
    inc = metrics.increase_from_events(ev, "ts", [], "5 minutes", "5 minutes").orderBy("t").collect()
    assert [r["increase"] for r in inc] == [2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    part, start, end = metrics.time_range(ev, "ts", "2024-01-01 00:40:00", "10 minutes", "30 minutes")
    assert part.count() == 3
    got = metrics.increase_from_events(part, "ts", [], "30 minutes", "5 minutes", start=start, end=end).orderBy("t").collect()
    assert [(r["t"].minute, r["increase"]) for r in got] == [(30, 2.0), (35, 1.0), (40, 1.0)]


def test_windows_against_brute_force(spark):
    rnd = random.Random(3)
    pts = sorted({(rnd.randrange(4000), rnd.randrange(50)) for _ in range(120)})
    pts = sorted({s: (s, v) for s, v in pts}.values())
    for window, step in ((300, 60), (90, 60), (60, 90), (120, 120)):
        got = {int((r["t"] - T0).total_seconds()): r["increase"] for r in metrics.increase_from_samples(
            samples(spark, pts), ["series"], [], window=f"{window} seconds", step=f"{step} seconds").collect()}
        want = {}
        for t in range(0, 4000 + window + step, step):
            inside = [p for p in pts if t - window < p[0] <= t]
            if len(inside) >= 2:
                want[t] = sum(b[1] if b[1] < a[1] else b[1] - a[1] for a, b in zip(inside, inside[1:]))
        assert got == {t: float(v) for t, v in want.items()}, (window, step)
