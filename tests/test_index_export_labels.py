"""Stored log index, pinned export, counts while writing, label matchers, paging
columns, column rules."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from fleetline import schemas
from fleetline.functions.exprs import canonical_json, hmac_sha256_hex, normalize_page, page_columns
from fleetline.operators import logs, metrics, snapshots

T0 = dt.datetime(2024, 1, 10)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def scanned_rows(df):
    """Rows that the file scans of an executed plan gave out."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    total, leaves = 0, plan.collectLeaves()
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        if m.contains("numOutputRows"):
            total += m.apply("numOutputRows").value()
    return rows, total


def test_index_search_equals_scan_and_skips_row_groups(spark, tmp_path):
    lines = spark.range(60_000).select(
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.concat(F.lit("pod-"), F.col("id") % 3).alias("pod"),
        F.concat(F.lit("heartbeat updated: sn="), F.when(F.col("id") % 2 == 0, "CPE-").otherwise("cpe-"), F.floor(F.col("id") / 100), F.lit(" wan_ip="),
                 F.sha2(F.col("id").cast("string"), 512)).alias("message"))
    odd = spark.createDataFrame([(T0, "pod-1", "two: sn=CPE-7 and sn=CPE-8"), (T0, "pod-1", "sn=sn=CPE-7"), (T0, "pod-1", "xsn=CPE-7"), (T0, "pod-1", None),
                                 (T0, "pod-1", "sn=Ö-1 here"), (T0 + dt.timedelta(days=3), "pod-1", "sn=CPE-7 later"), (T0, None, "SN=CPE-7,")], "ts timestamp_ntz, pod string, message string")
    d = lines.unionByName(odd)
    root = str(tmp_path)
    logs.write_index(d, root, row_group_bytes=64 << 10)
    for sn in ("CPE-7", "cpe-7", "CPE-77", "Ö-1", "CPE-599", "none"):
        got = logs.search_index(spark, root, sn, T0 + dt.timedelta(days=1), 2 * 24 * 60).select("ts", "pod", "message")
        assert rows_of(got) == rows_of(logs.search_sn(d, sn, T0 + dt.timedelta(days=1), 2 * 24 * 60)), sn
    hits, read = scanned_rows(logs.search_index(spark, root, "CPE-7", T0 + dt.timedelta(days=1), 2 * 24 * 60))
    assert len(hits) == 103 and read < 30_000                  # 60,006 lines are in these days
    _, none = scanned_rows(logs.search_index(spark, root, "CPE-99999", T0 + dt.timedelta(days=1), 2 * 24 * 60))
    assert none < read
    plan = logs.search_index(spark, root, "CPE-7", T0, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "EqualTo(sn_key,cpe-7)" in plan


def test_export_holds_the_instant_and_counts_while_writing(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(5).write.parquet(a)
    spark.range(7).write.parquet(b)
    now = (dt.datetime.now(dt.timezone.utc)).isoformat()
    pins = snapshots.pinned(spark, {"a": a, "b": b}, now)
    time.sleep(1.1)
    spark.range(100).write.mode("append").parquet(a)           # comes while the export runs
    spark.range(100).write.mode("append").parquet(b)
    folder = snapshots.export(pins, str(tmp_path / "out"), "2024-01-31T12:00:00")
    back = snapshots.restore(spark, str(tmp_path / "out"), "2024-01-31", ["a", "b"], register=False)
    assert (back["a"].count(), back["b"].count()) == (5, 7)
    assert rows_of(snapshots.counts(spark, str(tmp_path / "out"), "2024-01-31")) == [("a", 5), ("b", 7)]
    later = snapshots.pinned(spark, {"a": a}, now)             # an earlier instant can be asked for later
    assert later["a"].count() == 5
    assert snapshots.pinned(spark, {"a": a}, (dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=1)).isoformat())["a"].count() == 105
    listed = spark.read.parquet(f"{folder}/version=*/pins")
    assert listed.select("table").distinct().count() == 2 and listed.count() == len(pins["a"].inputFiles()) + len(pins["b"].inputFiles())
    with pytest.raises(RuntimeError, match="empty"):
        snapshots.export({"a": pins["a"].limit(0)}, str(tmp_path / "out"), "2024-01-31T12:00:00")


def test_matchers(spark):
    rows = [({"ns": "fleet", "svc": "api"}, T0, 1.0), ({"ns": "fleet", "svc": "api-2"}, T0, 2.0), ({"ns": "other"}, T0, 3.0), ({}, T0, 4.0), ({"ns": "fleet", "svc": ""}, T0, 5.0)]
    s = spark.createDataFrame(rows, "labels map<string,string>, ts timestamp_ntz, value double")
    got = lambda *m: sorted(r["value"] for r in metrics.matching(s, list(m)).collect())
    assert got(("ns", "=", "fleet")) == [1, 2, 5] and got(("ns", "!=", "fleet")) == [3, 4]
    assert got(("svc", "=~", "api")) == [1] and got(("svc", "=~", "api.*")) == [1, 2] and got(("svc", "!~", "api.*")) == [3, 4, 5]
    assert got(("svc", "=", "")) == [3, 4, 5] and got(("ns", "=", "fleet"), ("svc", "!=", "")) == [1, 2]
    with pytest.raises(KeyError):
        got(("ns", "~", "x"))
    d = metrics.label_columns(s, ["svc"])
    series = {r["value"]: [tuple(e) for e in r["series"]] for r in d.collect()}
    assert series[1.0] == [("ns", "fleet"), ("svc", "api")] and series[5.0] == [("ns", "fleet")]   # an empty label is no label
    out = metrics.latest_in_lookback(metrics.label_columns(metrics.matching(s, [("ns", "=", "fleet")]), ["svc"]), ["series"], ["svc"], step="5 minutes")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Filter") > plan.index("HashAggregate")     # the matchers are below the grouping


def test_page_columns_equal_the_parameter_rule(spark):
    texts = [None, "", "0", "1", "-3", "x", "20", "500", "501", "+7", "9223372036854775808", " 5", "5.0"]
    d = spark.createDataFrame([(o, n) for o in texts for n in texts], "o string, n string")
    offset, limit = page_columns("o", "n")
    for r in d.select("o", "n", offset.alias("a"), limit.alias("b")).collect():
        want = normalize_page(None if r["o"] == "9223372036854775808" else r["o"], None if r["n"] == "9223372036854775808" else r["n"])
        assert (r["a"], r["b"]) == want, r


def test_canonical_body_and_signature(spark):
    import hashlib
    import hmac
    import json
    d = spark.createDataFrame([("s", 5, None, "v1")], "sn string, cpu_pct int, wan_ip string, sw_version string")
    r = d.select(canonical_json("wan_ip", "sn", "sw_version", "cpu_pct").alias("b")).select("b", hmac_sha256_hex("b", "k").alias("h")).first()
    assert r["b"] == json.dumps({"sn": "s", "cpu_pct": 5, "sw_version": "v1"}, sort_keys=True, separators=(",", ":"))
    assert r["h"] == hmac.new(b"k", r["b"].encode(), hashlib.sha256).hexdigest()


def test_broken_rows_name_their_rules(spark):
    q = spark.createDataFrame(
        [(1, "acs", "s", T0, "p" * 100, "done", 1, T0, T0, T0), (2, "web", "x" * 65, T0, "p", "lost", 1, None, T0, T0), (None, None, "s", T0, None, "done", 1, T0, T0, T0)],
        "id long, source string, sn string, event_ts timestamp_ntz, payload string, status string, attempts int, next_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")
    got = {r["id"]: sorted(r["broken"]) for r in schemas.broken(q, schemas.QUEUE_SCHEMA, schemas.QUEUE_DOMAINS).collect()}
    assert got == {2: ["next_at_null", "sn_too_long", "source_domain", "status_domain"], None: ["id_null", "payload_null", "source_null"]}
