import hashlib
import hmac as py_hmac

import pytest
from pyspark.sql import functions as F

from fleetline.functions.exprs import (backoff_seconds, hmac_sha256_hex, normalize_batch,
                                       normalize_page, query_escape, rfc3339, round_ms,
                                       signature_ok)


def one(spark, col, value=None, schema="x string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("secret", ["", "s3cret", "k" * 64, "long" * 40])
def test_hmac_matches_python(spark, secret):
    body = '{"sn":"CPE-1","event_ts":"2024-01-01T00:00:00Z"}'
    want = py_hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    assert one(spark, hmac_sha256_hex(F.col("x"), secret), body) == want


def test_signature_rules(spark):
    body = '{"sn":"a"}'
    good = py_hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(body, None), (body, ""), (body, good), (body, good.upper()),
                                (body, "deadbeef")], "b string, s string")
    got = [r[0] for r in df.select(signature_ok("b", "s", "k")).collect()]
    assert got == [True, True, True, False, False]


@pytest.mark.parametrize("s,want", [
    ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"),
    ("2024-01-01T10:00:00+02:00", "2024-01-01 08:00:00"),
    ("2024-01-01T10:00:00.123456789Z", "2024-01-01 10:00:00.123456"),
    ("2024-01-01T10:00:00,5Z", "2024-01-01 10:00:00.500000"),
    ("2024-01-01", None), ("2024-01-01T10:00:00", None), ("2024-01-01 10:00:00Z", None),
    ("2024-02-30T00:00:00Z", None), ("", None), ("not-a-time", None),
])
def test_rfc3339(spark, s, want):
    got = one(spark, rfc3339(F.col("x")), s)
    if want is None:
        assert got is None
    else:
        assert str(got).startswith(want.rstrip("0").rstrip(".")) or str(got) == want


@pytest.mark.parametrize("s,want", [("2024-01-01 10:00:00.1235", "2024-01-01 10:00:00.124000"),
                                    ("2024-01-01 10:00:00.123499", "2024-01-01 10:00:00.123000"),
                                    ("2024-01-01 10:00:00.9995", "2024-01-01 10:00:01")])
def test_round_ms(spark, s, want):
    got = one(spark, round_ms(F.col("x").cast("timestamp_ntz")), s)
    assert got.isoformat(sep=" ").startswith(want.rstrip("0").rstrip("."))


def test_backoff(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 6, 70)], "n int")
    assert [r[0] for r in df.select(backoff_seconds("n")).collect()] == [5, 10, 160, 300, 300]
    q = spark.createDataFrame([(n,) for n in (1, 2, 3)], "n int")
    assert [r[0] for r in q.select(backoff_seconds("n", 7, None, offset=1)).collect()] == [7, 14, 28]


def test_paging_and_batch_params():
    assert normalize_page(0, 500) == (0, 500)
    for bad in (501, 0, -1, "x", None):
        assert normalize_page(0, bad)[1] == 50
    for bad in (-1, "x", None):
        assert normalize_page(bad, 10)[0] == 0
    assert normalize_batch(0) == 50 and normalize_batch(-1) == 50 and normalize_batch(7) == 7


def test_query_escape(spark):
    assert one(spark, query_escape(F.col("x")), "a b/c~*é") == "a+b%2Fc~%2A%C3%A9"
