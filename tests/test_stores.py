"""Stored state: buckets that a batch does not touch keep their files, a tick
reads open events only, batches that run again change nothing, and any cut
into batches gives the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetline.operators import ingest, queue, state
from fleetline.operators.state import sn_key
from fleetline.plans import stored
from fleetline.session import ensure_semantics
from fleetline.sources.buckets import BUCKET, PART, BucketTable, with_bucket
from fleetline.streaming.history_table import HISTORY, HistoryTable
from fleetline.streaming import QueueStore, current_status, drain_batch, merge_status, process_heartbeat_batch, status_store

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


ARRIVAL = "seq long, received_at timestamp_ntz, sn string, event_ts timestamp_ntz, payload string"


def heartbeats(spark, rows):
    ensure_semantics(spark)
    return ingest.classify_heartbeat(spark.createDataFrame(
        [(seq, T0 + dt.timedelta(seconds=seq), f'{{"sn":"{sn}","cpu_pct":{seq % 100}}}') for seq, sn in rows],
        "seq long, received_at timestamp_ntz, body string"))


def arrivals(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=s), sn, T0 + dt.timedelta(days=d), f"p{s}") for s, sn, d in rows], ARRIVAL)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# buckets ----------------------------------------------------------------------------------------------------------

def test_bucket_honours_the_collation(spark):
    names = ["abc", "ABC", "Abc", "ábc", "straße", "STRASSE", "x", "X", "x "]
    d = with_bucket(spark.createDataFrame([(n,) for n in names], "sn string"), 64, sn_key("sn"))
    got = {r["sn"]: r[BUCKET] for r in d.collect()}
    assert got["abc"] == got["ABC"] == got["Abc"] == got["ábc"] and got["straße"] == got["STRASSE"] and got["x"] == got["X"]
    assert len(set(got.values())) > 2


def test_versions_are_whole_and_old_readers_undisturbed(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), spark.createDataFrame([], "id long, v string").schema, 4)
    put = lambda rows: spark.createDataFrame(rows, "id long, v string, part string, bucket int")
    t.publish(put([(1, "a", "p", 0), (2, "b", "p", 1)]), feed="f", batch=0)
    before = t.read()
    t.publish(put([(1, "A", "p", 0)]), {"p": [0]}, "f", 1)
    t.publish(put([(3, "c", "p", 1)]), feed="f", batch=2)          # added, not replaced
    assert rows_of(t.read().select("id", "v")) == [(1, "A"), (2, "b"), (3, "c")]
    assert rows_of(before.select("id", "v")) == [(1, "a"), (2, "b")]
    assert rows_of(t.read(version=1).select("id", "v")) == [(1, "A"), (2, "b")]
    t.publish(put([]), {"p": [0]})                                  # a bucket may become empty
    assert rows_of(t.read().select("id", "v")) == [(2, "b"), (3, "c")]
    assert t.is_done("f", 2) and not t.is_done("f", 3) and not t.is_done("g", 0)
    assert t.read(["other"]).count() == 0 and t.crowded(t.manifest(), 1) == {"p": [1]}
    assert all("bucket=0" in f for f in t.unreferenced(keep=1))
    with pytest.raises(ValueError, match="4 buckets"):
        BucketTable(spark, str(tmp_path), t.schema, 8).read()


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), spark.createDataFrame([], "id long").schema, 2)
    rows = spark.createDataFrame([(1, "p", 0)], "id long, part string, bucket int")
    t.publish(rows)
    with pytest.raises(Exception, match="lost"):
        t.publish(rows.withColumn("id", F.raise_error(F.lit("lost")).cast("long")))
    assert rows_of(t.read().select("id")) == [(1,)]
    t.publish(rows.withColumn("id", F.col("id") + 1))
    assert rows_of(t.read().select("id")) == [(1,), (2,)]


# latest state -----------------------------------------------------------------------------------------------------

def test_batches_rewrite_the_buckets_of_their_devices_only(spark, tmp_path):
    store = status_store(spark, str(tmp_path), buckets=8)
    merge_status(store, heartbeats(spark, [(k, f"CPE-{k}") for k in range(40)]), 0)
    first = set(store.files(store.manifest()))
    assert len(first) == 8
    merge_status(store, heartbeats(spark, [(100, "cpe-3"), (101, "new")]), 1)
    second = set(store.files(store.manifest()))
    assert 6 <= len(first & second) < 8          # one or two buckets are new files, the others keep theirs
    merge_status(store, heartbeats(spark, [(100, "cpe-3"), (101, "new")]), 1)
    assert len(store.versions()) == 2            # done: nothing happens
    got = {r["sn"]: (r["cpu_pct"], r["seq"]) for r in current_status(spark, str(tmp_path), 8).collect()}
    assert got["CPE-3"] == (0, 100) and got["new"] == (1, 101) and len(got) == 41 and got["CPE-4"] == (4, 4)


@pytest.mark.parametrize("seed", [1])
def test_any_cut_gives_the_batch_state(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["a", "A", "á", "b", "B", "ss", "ß", "c " , "c"]
    rows = [(k, rng.choice(names)) for k in range(60)]
    cuts = sorted({0, 60, *rng.sample(range(60), 3)})
    store = status_store(spark, str(tmp_path), buckets=4)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        merge_status(store, heartbeats(spark, rows[a:b]), n)
    got = current_status(spark, str(tmp_path), 4).drop("received_at", "seq", "first_seq")
    assert rows_of(got) == rows_of(state.latest_state(heartbeats(spark, rows)).select(*got.columns))


def test_empty_batch(spark, tmp_path):
    process_heartbeat_batch(spark.createDataFrame([], "seq long, received_at timestamp_ntz, body string"), 0, str(tmp_path))
    assert current_status(spark, str(tmp_path)).count() == 0


def test_taken_keys_are_found_without_shuffling_the_history(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path), buckets=4)
    row = lambda d, s: (d, at(s), f"d{d}", None, None, None, None, None)
    frame = lambda rows: spark.createDataFrame(rows, HISTORY)
    table.append(frame([row(d, s) for d in range(6) for s in range(3)]), 0)
    table.append(frame([row(7, 0)]), 1)
    table.append(frame([row(8, 0)]), 1)                          # the batch runs again
    assert table.read().where("batch_id = 1").select("device").collect()[0][0] == 8 and table.read().count() == 19
    asked = frame([row(1, 1), row(1, 5), row(8, 0), row(9, 0)])
    got = {(r["device"], r["event_ts"]): r["taken"] for r in table.marked(asked, 2).collect()}
    assert got == {(1, at(1)): True, (1, at(5)): False, (8, at(0)): True, (9, at(0)): False}
    assert not any(r["taken"] for r in table.marked(frame([row(8, 0)]), 1).collect())   # its own rows do not count
    plan = table.marked(asked, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "PartitionFilters" in plan and "event_date" in plan
    spark.sql(f"DROP TABLE {table.name}")                        # another session registers the files anew
    assert HistoryTable(spark, str(tmp_path), buckets=4).read().count() == 19


# queue ------------------------------------------------------------------------------------------------------------

def test_a_tick_reads_open_buckets_only_whatever_is_finished(spark, tmp_path):
    inputs, sizes = [], []
    for name, finished in (("few", 20), ("many", 200)):
        store = QueueStore(spark, str(tmp_path / name), buckets=4)
        store.enqueue(arrivals(spark, [(k, f"d{k}", 0) for k in range(finished)]), 0)
        store.apply(queue.drain(store.open_events(), "2024-02-01 00:00:00", 10_000), "ticks", 0)
        assert store.open_events().count() == 0
        store.enqueue(arrivals(spark, [(1000 + k, f"e{k}", 0) for k in range(30)]), 1)
        files = store.tick("2024-02-01 00:00:01", 10).inputFiles()
        assert files and all("/part=open/" in f for f in files)
        inputs.append(store.open_events().count())
        sizes.append(len(files))
        assert store.table().count() == finished + 30
    assert inputs == [30, 30] and sizes[0] == sizes[1]


def test_drained_events_move_and_finished_files_stay(spark, tmp_path):
    store = QueueStore(spark, str(tmp_path), buckets=4)
    store.enqueue(arrivals(spark, [(k, f"d{k}", 0) for k in range(40)]), 0)
    store.apply(store.tick("2024-02-01 00:00:00", 25), "ticks", 0)
    done = {f for f in store.state.files(store.state.manifest()) if "part=terminal" in f}
    store.apply(store.tick("2024-02-01 00:00:01", 3), "ticks", 1)
    assert done < {f for f in store.state.files(store.state.manifest()) if "part=terminal" in f}  # added to, never rewritten
    assert store.open_events().count() == 12
    assert {r["status"]: r["events"] for r in store.depth("2024-02-01 00:00:02").collect()} == {"done": 28, "queued": 12}
    assert store.lag("2024-02-01 00:00:02").first()["open_events"] == 12
    before = rows_of(store.table())
    store.compact(1)
    assert rows_of(store.table()) == before and not any(store.state.crowded(store.state.manifest(), 1).values())


@pytest.mark.parametrize("seed", [3])
def test_stored_queue_equals_the_fold_of_the_whole_logs(spark, tmp_path, seed):
    """Arrivals (with re-sent events, other spellings) and writer actions in
    random turns, some of them run twice."""
    rng = random.Random(seed)
    store = QueueStore(spark, str(tmp_path), buckets=3)
    every, actions, seq = [], [], 0
    for turn in range(3):
        rows = []
        for _ in range(12):
            seq += 1
            rows.append((seq * 60, rng.choice(["a", "A", "b", "ß", "ss", f"n{seq}"]), rng.randrange(3)))
        every += rows
        for _ in range(rng.choice([1, 2])):
            store.enqueue(arrivals(spark, rows), turn)
        at = T0 + dt.timedelta(seconds=seq * 60 + 30)
        out = queue.drain(store.open_events(), at, 5)
        fails = [tuple(r) for r in out.where("status = 'processing'").collect()]
        some = [(i, at + dt.timedelta(seconds=1), 2, rng.choice(["done", "dead", "queued"]), n, at + dt.timedelta(seconds=90), "x") for i, _, _, _, n, _, _ in fails]
        rows = fails + some + [(10**9, at, 0, "done", 1, None, None)]  # the last one: an id that no arrival has
        actions += rows
        for _ in range(rng.choice([1, 2])):
            store.apply(spark.createDataFrame(rows, "id long, at timestamp_ntz, seq long, status string, attempts int, next_at timestamp_ntz, reason string"), "writer", turn)
    whole = queue.fold(arrivals(spark, every), spark.createDataFrame(
        actions, "id long, at timestamp_ntz, seq long, status string, attempts int, next_at timestamp_ntz, reason string"))
    assert rows_of(store.table().select(*whole.columns)) == rows_of(whole)
    state_rows = store.state.read()
    assert state_rows.where((F.col(PART) == "open") != F.col("status").isin("queued", "processing")).count() == 0


def test_a_resent_finished_event_is_open_again_under_its_old_id(spark, tmp_path):
    store = QueueStore(spark, str(tmp_path), buckets=4)
    store.enqueue(arrivals(spark, [(1, "Dev", 0), (2, "other", 0)]), 0)
    store.apply(store.tick("2024-01-02 00:00:00", 50), "ticks", 0)
    store.enqueue(arrivals(spark, [(200_000, "dev", 0)]), 1)
    got = {r["id"]: (r["sn"], r["status"], r["attempts"], r["payload"]) for r in store.table().collect()}
    assert got == {1: ("Dev", "queued", 0, "p200000"), 2: ("other", "done", 1, "p2")}


def test_drain_batch_that_runs_again_drains_nothing_more(spark, tmp_path):
    sink = str(tmp_path)
    QueueStore(spark, f"{sink}/queue").enqueue(arrivals(spark, [(k, f"d{k}", 0) for k in range(30)]), 0)
    first = rows_of(drain_batch(spark, sink, "2024-02-01 00:00:00", 0, 10))
    assert rows_of(drain_batch(spark, sink, "2024-02-01 00:00:00", 0, 10)) == first and len(first) == 20
    assert QueueStore(spark, f"{sink}/queue").open_events().count() == 20
    assert drain_batch(spark, sink, "2023-01-01 00:00:00", 1, 10).count() == 0  # nothing is ready then


def test_h4_decodes_on_all_cores(spark, monkeypatch):
    """A feed in one split is dealt to all shuffle partitions before its bodies are decoded."""
    ensure_semantics(spark)
    rows = spark.createDataFrame([(n, T0 + dt.timedelta(hours=n), f'{{"sn":"d{n % 7}","cpu_pct":{n % 100}}}') for n in range(700)],
                                 "seq long, received_at timestamp_ntz, body string").coalesce(1)
    classify, seen = ingest.classify_heartbeat, []
    monkeypatch.setattr(stored.fx, "heartbeat_arrivals", lambda *_: rows)
    monkeypatch.setattr(stored.ingest, "classify_heartbeat", lambda part: seen.append(part.rdd.getNumPartitions()) or classify(part))
    got = stored.h4_stored_state(spark, "")
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 4
    assert rows_of(got) == rows_of(state.latest_state(classify(rows)))
