"""The queue fold equals a sequential replay of both logs."""

import datetime as dt
import random

from fleetline.operators import queue

T0 = dt.datetime(2024, 3, 1)


def replay(arrivals, transitions):
    """Row-by-row state machine in (at, src, seq) order."""
    events = [(a[1], 0, a[0], "a", a) for a in arrivals] + [(t[1], 1, t[2], "t", t) for t in transitions]
    by_key, rows = {}, {}
    for at, _src, _seq, kind, e in sorted(events, key=lambda x: (x[0], x[1], x[2])):
        if kind == "a":
            seq, received, sn, ets, payload = e
            k = (sn.lower(), ets)
            if k not in by_key:
                by_key[k] = seq
                rows[seq] = dict(id=seq, sn=sn, event_ts=ets, created=received)
            r = rows[by_key[k]]
            r.update(payload=payload, status="queued", attempts=0, next_at=received, updated=at)
        else:
            id_, at, _seq, status, attempts, next_at = e
            if id_ not in rows:
                continue
            r = rows[id_]
            r.update(status=status, attempts=attempts, updated=at)
            if next_at is not None:
                r["next_at"] = next_at
    return {i: (r["sn"], r["event_ts"], r["payload"], r["status"], r["attempts"],
                r["next_at"].replace(microsecond=0), r["created"].replace(microsecond=0),
                r["updated"].replace(microsecond=0)) for i, r in rows.items()}


def test_fold_matches_replay(spark):
    rnd = random.Random(5)
    for _ in range(3):
        arrivals, transitions, seq, clock = [], [], 0, T0
        keys = [(rnd.choice(["CPE-A", "cpe-a", "CPE-B"]), T0 + dt.timedelta(hours=rnd.randrange(3)))
                for _ in range(6)]
        for _ in range(60):
            clock += dt.timedelta(seconds=rnd.randrange(1, 90))
            seq += 1
            if rnd.random() < 0.45 or not arrivals:
                sn, ets = rnd.choice(keys)
                arrivals.append((seq, clock, sn, ets, f"p{seq}"))
            else:
                ids = sorted({min(a[0] for a in arrivals if (a[2].lower(), a[3]) == (x[2].lower(), x[3]))
                              for x in arrivals})
                status = rnd.choice(["processing", "done", "queued", "dead"])
                nxt = clock + dt.timedelta(seconds=30) if status == "queued" else None
                transitions.append((rnd.choice(ids + [999]), clock, seq, status, rnd.randrange(6), nxt))
        a = spark.createDataFrame(arrivals, "seq long, received_at timestamp_ntz, sn string, "
                                            "event_ts timestamp_ntz, payload string")
        t = spark.createDataFrame(transitions, "id long, at timestamp_ntz, seq long, status string, "
                                               "attempts int, next_at timestamp_ntz")
        got = {r["id"]: (r["sn"], r["event_ts"], r["payload"], r["status"], r["attempts"], r["next_at"],
                         r["created_at"], r["updated_at"]) for r in queue.fold(a, t).collect()}
        assert got == replay(arrivals, transitions)
