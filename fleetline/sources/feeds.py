"""File sources for the raw feeds.

Arrival records are what a receiving endpoint appends: one record per
request with an arrival sequence, the arrival time, the raw body and (for
webhooks) the signature header.  Container logs are plain text files under
the node's log directory; the file path carries the pod metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline import schemas as S


def read_arrivals(spark: SparkSession, path: str, webhooks: bool = False,
                  fmt: str = "parquet") -> DataFrame:
    """Batch read of arrival records (``seq, received_at, body[, signature]``),
    with a fixed schema (no inference)."""
    schema = S.WEBHOOK_ARRIVAL_SCHEMA if webhooks else S.ARRIVAL_SCHEMA
    return spark.read.schema(schema).format(fmt).load(path)


def stream_arrivals(spark: SparkSession, path: str, webhooks: bool = False,
                    fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    schema = S.WEBHOOK_ARRIVAL_SCHEMA if webhooks else S.ARRIVAL_SCHEMA
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def read_container_logs(spark: SparkSession, glob: str = "/var/log/containers/*.log",
                        cri: bool = True) -> DataFrame:
    """``(path, ts, line)`` from container log files.  With ``cri`` the
    runtime's line format ``<RFC3339 time> <stream> <tag> <message>`` is
    split; otherwise ``ts`` is NULL and ``line`` is the raw text."""
    t = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    if not cri:
        return t.select("path", F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("value").alias("line"))
    rx = r"^(\S+) (stdout|stderr) (\S+) (.*)$"
    ts = F.regexp_extract("value", rx, 1)
    from fleetline.functions.exprs import rfc3339
    return t.select("path", rfc3339(F.nullif(ts, F.lit(""))).alias("ts"),
                    F.when(F.col("value").rlike(rx), F.regexp_extract("value", rx, 4))
                    .otherwise(F.col("value")).alias("line"))
