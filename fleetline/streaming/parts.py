"""Output folders of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_partition(df: DataFrame, path: str, batch_id: int, date_col: str | None = None) -> None:
    """Write a batch's rows as the partition ``batch_id``.  What an earlier run
    of the same batch left is dropped first: a dynamic overwrite with an empty
    result would leave it in place."""
    d = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    parts = ["batch_id"] + ([date_col] if date_col else [])
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    d.write.mode("append").partitionBy(*parts).parquet(path)
