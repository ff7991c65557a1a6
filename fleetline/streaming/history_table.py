"""The append-only history as a bucketed table (H2, H3).

A key of the history is a device and a millisecond.  Serial numbers compare
folded, which bucketing cannot do; the rows therefore also carry ``device``, the
first arrival of the device, which the latest state keeps and which never
changes.  The table is bucketed and sorted by ``(device, event_ts)``: the
question which keys of a batch are taken is a merge join in which the history
is read where it is and only the batch is shuffled.  Folders by batch and day
prune what is read to the days of the batch, and a batch that runs again
replaces its own folder.

The files are plain Parquet; the bucketing is known to Spark through a table
that each session registers over them (``buckets`` is part of the layout)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.sources.buckets import columns
from fleetline.streaming.parts import exists

BUCKETS = 4
HISTORY = ("device bigint, event_ts timestamp_ntz, sn string, last_seen timestamp_ntz, wan_ip string, sw_version string, "
           "cpu_pct tinyint, mem_pct tinyint")


class HistoryTable:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.name = "history_" + hashlib.md5(f"{root} {buckets}".encode()).hexdigest()
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({HISTORY}, batch_id bigint, event_date date) USING parquet "
                      f"PARTITIONED BY (batch_id, event_date) CLUSTERED BY (device, event_ts) SORTED BY (device, event_ts) "
                      f"INTO {buckets} BUCKETS LOCATION '{root}'")
            if exists(spark, root):
                spark.catalog.recoverPartitions(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """The batch's rows (columns of ``HISTORY``), in place of what an earlier
        run of the batch left."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch_id={batch_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch_id = {batch_id})")
        d = rows.select(*columns(HISTORY), F.lit(batch_id).cast("long").alias("batch_id"), F.to_date("event_ts").alias("event_date"))
        d.repartition(self.buckets, "device", "event_ts").write.insertInto(self.name)

    def marked(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """``rows`` with ``taken``: whether another batch has stored the key.  The
        days of the rows bound what is read."""
        days = rows.agg(F.min(F.to_date("event_ts")).alias("lo"), F.max(F.to_date("event_ts")).alias("hi")).first()
        old = self.read().where(F.col("event_date").between(F.lit(days["lo"]), F.lit(days["hi"])) & (F.col("batch_id") != batch_id))
        old = old.select("device", "event_ts", F.lit(True).alias("_old"))
        return rows.join(old.hint("merge"), ["device", "event_ts"], "left").withColumn("taken", F.coalesce("_old", F.lit(False))).drop("_old")
