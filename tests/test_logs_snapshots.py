import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetline.operators import logs, snapshots

T0 = dt.datetime(2024, 1, 10)


def test_sn_phrase_and_decode(spark):
    df = spark.createDataFrame([
        ("/var/log/containers/api-0_fleet_api-abc123.log", T0, "heartbeat updated: sn=CPE-1 wan_ip=x"),
        ("/var/log/containers/api-0_fleet_api-abc123.log", T0, "heartbeat updated: sn=CPE-10 wan_ip=x"),
        ("odd-path.log", T0, '["message","array"]'),
        ("/var/log/containers/api-9_fleet_api-abc123.log", T0, '{"message":"x sn=cpe-1","level":"warn"}'),
    ], "path string, ts timestamp_ntz, line string")
    d = logs.decode(df)
    hits = logs.search_sn(d, "CPE-1", T0, 10).collect()
    assert sorted(r["message"] for r in hits) == ["heartbeat updated: sn=CPE-1 wan_ip=x", "x sn=cpe-1"]
    js = [r for r in d.collect() if r["line"].startswith("{")][0]
    assert js["fields"] == {"message": "x sn=cpe-1", "level": "warn"}
    trailing = logs.decode(spark.createDataFrame([('{"message":"m"} tail',)], "line string")).first()
    assert not trailing["decoded"] and trailing["message"] == '{"message":"m"} tail'
    arr = [r for r in d.collect() if r["path"] == "odd-path.log"][0]
    assert arr["message"] == '["message","array"]' and not arr["decoded"]
    pods = spark.createDataFrame([("fleet", "api-0", "api", "n1")], "namespace string, pod string, app string, node string")
    e = {r["line"]: r for r in logs.enrich(d, pods).collect()}
    assert e['["message","array"]']["pod"] is None
    assert e['{"message":"x sn=cpe-1","level":"warn"}']["app"] is None
    assert e["heartbeat updated: sn=CPE-1 wan_ip=x"]["app"] == "api"


def test_retention_and_mirror(spark):
    m = spark.createDataFrame([("a", 1, T0 - dt.timedelta(days=7)), ("b", 1, T0 - dt.timedelta(days=7, seconds=1))],
                              "path string, bytes long, modified_at timestamp_ntz")
    assert [r["path"] for r in snapshots.expired(m, T0, 7).collect()] == ["b"]
    src = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "rel_path string, bytes long")
    dst = spark.createDataFrame([("y", 2), ("z", 4), ("extra", 9)], "rel_path string, bytes long")
    plan = {r["rel_path"]: r["action"] for r in snapshots.mirror_plan(src, dst).collect()}
    assert plan == {"x": "copy_new", "y": "skip", "z": "overwrite"}


def test_export_verify_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    folder = snapshots.export({"t": df}, str(tmp_path), "2024-01-31T23:30:00")
    assert folder.endswith("snapshot_date=2024-02-01")      # Copenhagen is UTC+1
    back = snapshots.restore(spark, str(tmp_path), "2024-02-01", ["t"])["t"]
    assert [tuple(r) for r in back.collect()] == [(1, "a")]
    with pytest.raises(RuntimeError):
        snapshots.export({"t": df.limit(0)}, str(tmp_path), "2024-01-31T23:30:00")
    back = snapshots.restore(spark, str(tmp_path), "2024-02-01", ["t"])["t"]
    assert [tuple(r) for r in back.collect()] == [(1, "a")]  # the failed export replaced nothing
    snapshots.export({"t": df.withColumn("v", F.lit("b"))}, str(tmp_path), "2024-01-31T23:30:00")
    assert snapshots.restore(spark, str(tmp_path), "2024-02-01", ["t"])["t"].first()["v"] == "b"
    man = snapshots.list_objects(spark, str(tmp_path))
    assert man.where("snapshot_date = '2024-02-01'").count() >= 1
