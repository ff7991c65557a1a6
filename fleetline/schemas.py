"""Table shapes and column constraints.

The stored tables follow the reference schema: a queue of ingest events, the
latest state per device and its history.  Constraint violations reject the
whole row (strict SQL mode), they never truncate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column limits and domains of the reference tables.
VARCHAR_LIMIT = 64
TINYINT_MIN, TINYINT_MAX = -128, 127
QUEUE_STATUSES = ("queued", "processing", "done", "dead")
QUEUE_SOURCES = ("acs", "cpe")
DATETIME_MIN = "1000-01-01 00:00:00"
DATETIME_MAX = "9999-12-31 23:59:59.999"

ARRIVAL_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("received_at", T.TimestampNTZType(), False),
    T.StructField("body", T.StringType(), True),
])

WEBHOOK_ARRIVAL_SCHEMA = T.StructType(ARRIVAL_SCHEMA.fields + [
    T.StructField("signature", T.StringType(), True),
])

STATUS_SCHEMA = T.StructType([
    T.StructField("sn", T.StringType(), False),
    T.StructField("last_seen", T.TimestampNTZType(), True),
    T.StructField("wan_ip", T.StringType(), True),
    T.StructField("sw_version", T.StringType(), True),
    T.StructField("cpu_pct", T.ByteType(), True),
    T.StructField("mem_pct", T.ByteType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("sn", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("last_seen", T.TimestampNTZType(), True),
    T.StructField("wan_ip", T.StringType(), True),
    T.StructField("sw_version", T.StringType(), True),
    T.StructField("cpu_pct", T.ByteType(), True),
    T.StructField("mem_pct", T.ByteType(), True),
])

QUEUE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("sn", T.StringType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("next_at", T.TimestampNTZType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])


QUEUE_DOMAINS = {"status": QUEUE_STATUSES, "source": QUEUE_SOURCES}


def broken(rows: DataFrame, schema: T.StructType, domains: dict[str, tuple] | None = None) -> DataFrame:
    """The rows that break a rule of the table: a column that must not be
    NULL, a text over its length, a value outside its domain, a number or time
    out of range.  Adds ``broken``, the names of the rules."""
    checks = []
    for f in schema.fields:
        c = F.col(f.name)
        if not f.nullable:
            checks.append((f"{f.name}_null", c.isNull()))
        if f.name in (domains or {}):
            checks.append((f"{f.name}_domain", c.isNotNull() & ~c.isin(*domains[f.name])))
        elif isinstance(f.dataType, T.StringType) and f.name != "payload":
            checks.append((f"{f.name}_too_long", too_long(c)))
        elif isinstance(f.dataType, T.ByteType):
            checks.append((f"{f.name}_range", out_of_tinyint(c)))
        elif isinstance(f.dataType, T.TimestampNTZType):
            checks.append((f"{f.name}_range", out_of_datetime(c)))
    return rows.withColumn("broken", violations(checks)).where(F.size("broken") > 0)


def too_long(c: Column) -> Column:
    return c.isNotNull() & (F.char_length(c) > VARCHAR_LIMIT)


def out_of_tinyint(c: Column) -> Column:
    return c.isNotNull() & ((c < TINYINT_MIN) | (c > TINYINT_MAX))


def out_of_datetime(c: Column) -> Column:
    return c.isNotNull() & ((c < F.lit(DATETIME_MIN).cast("timestamp_ntz"))
                            | (c > F.lit(DATETIME_MAX).cast("timestamp_ntz")))


def violations(checks: list[tuple[str, Column]]) -> Column:
    """ARRAY<STRING> of the names of the failed checks (empty = row ok)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
