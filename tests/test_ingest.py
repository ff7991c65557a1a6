import datetime as dt
import hashlib
import hmac as py_hmac

import pytest
from pyspark.sql import functions as F

from fleetline.operators import ingest

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def webhook(spark, body, sig=None, secret="k"):
    df = spark.createDataFrame([(1, T0, body, sig)],
                               "seq long, received_at timestamp_ntz, body string, signature string")
    r = ingest.classify_webhook(df, secret).first()
    return r["code"], r["reason"], r["sn"], r["event_ts"]


@pytest.mark.parametrize("body", ['{"sn":"a"} x', '{"sn":"a"}]', "", "bad", "{'sn':'a'}", '{sn:"a"}',
                                  '{"sn":"a",}', '{"sn":NaN}', "[]", "5", '"x"', '{"sn":1}',
                                  '{"sn":"a","event_ts":1}', '{"sn":"a"}, "x"'])
def test_webhook_invalid_json(spark, body):
    assert webhook(spark, body)[:2] == (400, "invalid_json")


@pytest.mark.parametrize("body", ["null", "{}", '{"sn":null}', '{"sn":""}'])
def test_webhook_missing_sn(spark, body):
    assert webhook(spark, body)[:2] == (400, "missing_sn")


def test_webhook_accepts_whitespace_sn_and_duplicate_keys(spark):
    assert webhook(spark, '{"sn":" "}')[:3] == (202, None, " ")
    assert webhook(spark, '{"sn":"a","sn":"b"}')[2] == "b"
    assert webhook(spark, '{"SN":"up"}')[2] == "up"


def test_webhook_signature_order(spark):
    body = '{"sn":"a"}'
    good = py_hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    assert webhook(spark, body, None)[0] == 202
    assert webhook(spark, body, "")[0] == 202
    assert webhook(spark, body, good)[0] == 202
    assert webhook(spark, body, good.upper())[:2] == (401, "invalid_signature")
    assert webhook(spark, "not json", "deadbeef")[:2] == (401, "invalid_signature")


def test_webhook_event_time(spark):
    assert webhook(spark, '{"sn":"a","event_ts":"2024-01-01T10:00:00+02:00"}')[3] == dt.datetime(2024, 1, 1, 8)
    for bad in ("2024-01-01", "not-a-time", ""):
        assert webhook(spark, '{"sn":"a","event_ts":"%s"}' % bad)[3] == T0
    assert webhook(spark, '{"sn":"%s"}' % ("x" * 65))[:2] == (500, "db_error")


def heartbeat(spark, body):
    df = spark.createDataFrame([(1, T0, body)], "seq long, received_at timestamp_ntz, body string")
    return ingest.classify_heartbeat(df).first()


@pytest.mark.parametrize("body", ['{"sn":"a","cpu_pct":5.0}', '{"sn":"a","cpu_pct":1e2}',
                                  '{"sn":"a","cpu_pct":"5"}', "null", "", "[1]", '{"sn":""}'])
def test_heartbeat_400(spark, body):
    assert heartbeat(spark, body)["code"] == 400


def test_heartbeat_values(spark):
    r = heartbeat(spark, '{"sn":"a","cpu_pct":120}')
    assert r["code"] == 202 and r["cpu_pct"] == 120 and r["last_seen"] == T0
    assert heartbeat(spark, '{"sn":"a","cpu_pct":128}')["code"] == 500
    assert heartbeat(spark, '{"sn":"a","mem_pct":-129}')["code"] == 500
    assert heartbeat(spark, '{"sn":"%s"}' % ("x" * 65))["code"] == 500
    assert heartbeat(spark, '{"sn":"a"} x')["code"] == 202
    r = heartbeat(spark, '{"sn":"a","last_seen":"2024-01-01T10:00:00.1235Z"}')
    assert r["last_seen"] == dt.datetime(2024, 1, 1, 10, 0, 0, 124000)


def test_body_limit(spark):
    big = '{"sn":"a","pad":"' + "x" * (1 << 20) + '"}'
    assert heartbeat(spark, big)["code"] == 413


def test_last_spelling_of_a_key_counts_and_a_forged_tail_fails(spark):
    bodies = ['{"sn":"a","SN":"b"}', '{"SN":"b","sn":"a"}', '{"sn":"a","SN":"b","sn":"c"}', '{"Sn":"z","x":{"sn":"q"}}',
              '{"sn":"a"},"\\u0000fleetline-eof"] junk', '{"sn":"a"},"x"]']
    df = spark.createDataFrame([(i, b, None) for i, b in enumerate(bodies)], "seq long, body string, signature string").withColumn(
        "received_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    out = [(r["code"], r["sn"]) for r in ingest.classify_webhook(df, "k").orderBy("seq").collect()]
    assert out == [(202, "b"), (202, "a"), (202, "c"), (202, "z"), (400, None), (400, None)]
    heart = [(r["code"], r["sn"]) for r in ingest.classify_heartbeat(df.drop("signature")).orderBy("seq").collect()]
    assert heart == [(202, "b"), (202, "a"), (202, "c"), (202, "z"), (202, "a"), (202, "a")]


def test_time_filter_after_classification_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "arrivals")
    spark.createDataFrame([(1, '{"sn":"a"}', None)], "seq long, body string, signature string").withColumn(
        "received_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(path)
    arrivals = spark.read.parquet(path)
    for c in (ingest.classify_webhook(arrivals, "k"), ingest.classify_heartbeat(arrivals.drop("signature"))):
        plan = c.where("code = 202 and received_at > timestamp_ntz'2023-12-31 00:00:00'")
        assert "GreaterThan(received_at" in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() == 1
