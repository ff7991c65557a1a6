"""SparkSession helpers.

``build_session`` is for tests, the bench and command-line use.  Library code
never creates a session; it calls ``ensure_semantics`` on the session it is
given so that results do not depend on the caller's time zone or JSON policy.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings the operators' semantics depend on.
SEMANTIC_CONF = {
    # All timestamps are UTC wall-clock (TIMESTAMP_NTZ in outputs).
    "spark.sql.session.timeZone": "UTC",
    # Duplicate JSON keys: the last one wins, as in the reference decoder.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings for scale: adaptive execution re-plans joins, coalesces small
# shuffle partitions and splits skewed ones at runtime.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Coalescing never merges shuffle partitions below this size into one;
    # only small shuffles are affected (large ones follow the advisory
    # partition size), so small stages keep using all cores instead of one.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
                 executors_cores: int | None = None) -> dict:
    """Settings for a cluster job over ``input_bytes`` of input: scan splits
    and post-shuffle partitions of about ``target_partition_bytes`` (they fit
    executor memory and spill cleanly), and at least one shuffle partition
    per core; adaptive execution then coalesces small ones and splits
    skewed ones."""
    parts = max(1, input_bytes // target_partition_bytes)
    if executors_cores:
        parts = max(parts, executors_cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        **SCALE_CONF,
    }


def ensure_semantics(spark: SparkSession) -> SparkSession:
    for k, v in SEMANTIC_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir`` of
    the session; a temporary one only where the session names none (tests)."""
    shared = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(shared or tempfile.mkdtemp(prefix='fleetline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "fleetline", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("FLEETLINE_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("FLEETLINE_DRIVER_MEMORY", "16g")))
    for k, v in {**SEMANTIC_CONF, **SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
