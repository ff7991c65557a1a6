import datetime as dt

from pyspark.sql import functions as F

from fleetline.operators import metrics, reads, snapshots

T0 = dt.datetime(2024, 1, 1)


def status_df(spark, rows):
    return spark.createDataFrame(rows, "sn string, last_seen timestamp_ntz, wan_ip string, sw_version string, "
                                       "cpu_pct tinyint, mem_pct tinyint, updated_at timestamp_ntz")


def history_df(spark, rows):
    return spark.createDataFrame(rows, "sn string, event_ts timestamp_ntz, last_seen timestamp_ntz, wan_ip string, "
                                       "sw_version string, cpu_pct tinyint, mem_pct tinyint")


def test_device_report_and_lookup(spark):
    st = status_df(spark, [("CPE-1", T0, "1.1.1.1", "v1", 5, 6, T0)])
    hist = history_df(spark, [("cpe-1", T0 + dt.timedelta(seconds=i), T0, "ip", "v1", i, 0) for i in range(25)]
                      + [("CPE-9", T0, T0, "ip9", "v1", 1, 1)])
    rep = reads.device_report(st, hist, 20, "https://d/?sn=%s", None).collect()
    one = [r for r in rep if r["device"] == "CPE-1"]
    assert len(one) == 20 and sorted(r["rank"] for r in one) == list(range(1, 21))
    assert min(r["h_cpu_pct"] for r in one) == 5                     # the 20 newest of 25
    assert one[0]["dashboard_url"] == "https://d/?sn=CPE-1" and one[0]["logs_url"] is None
    nine = [r for r in rep if r["device"] == "CPE-9"]
    assert len(nine) == 1 and nine[0]["error"] == "SN not found" and not nine[0]["found"]
    req = spark.createDataFrame([("cpe-1",), ("CPE-2",)], "request_sn string")
    got = {r["request_sn"]: r["found"] for r in reads.lookup(st, req).collect()}
    assert got == {"cpe-1": True, "CPE-2": False}
    assert [r["event_ts"] for r in reads.latest_n_for(hist, "  CPE-1 ", 1).collect()] == \
        [T0 + dt.timedelta(seconds=24)]


def test_ratio_and_lookback(spark):
    ev = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), c) for m, c in
                                [(1, "200"), (2, "500"), (3, "503"), (4, "200")]], "ts timestamp_ntz, code string")
    pct = metrics.ratio_pct(ev, "ts", F.col("code").rlike("^(?:5..)$"), "5 minutes", "5 minutes").collect()
    assert [(r["t"], r["pct"]) for r in pct] == [(T0 + dt.timedelta(minutes=5), 50.0)]
    none = metrics.ratio_pct(ev.where("false"), "ts", F.col("code") == "500", "5 minutes", "5 minutes")
    assert none.count() == 0                                          # no traffic, no ratio row
    up = spark.createDataFrame([
        (T0 + dt.timedelta(seconds=10), "api", "a-0", 1.0), (T0 + dt.timedelta(seconds=50), "api", "a-0", 0.0),
        (T0 + dt.timedelta(seconds=20), "api", "a-1", 1.0), (T0 + dt.timedelta(seconds=30), "api-x", "b", 1.0)],
        "ts timestamp_ntz, service string, instance string, value double")
    r = metrics.latest_in_lookback(up, ["service", "instance"], ["service"], lookback="1 minute",
                                   step="1 minute", label_regex={"service": "api"}, name="up").collect()
    assert [(x["service"], x["up"]) for x in r] == [("api", 1.0)]     # latest per series, anchored regex


def test_latest_snapshot(spark):
    m = snapshots.manifest(spark.createDataFrame(
        [("b/2024-01-02/x.parquet", 1, T0), ("b/2024-01-03/y.parquet", 1, T0), ("b/2024-01-01/z.parquet", 1, T0)],
        "path string, bytes long, modified_at timestamp_ntz"))
    assert snapshots.latest(m).first()["path"] == "b/2024-01-03/y.parquet"
