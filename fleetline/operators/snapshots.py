"""Dated snapshots, retention and mirroring.

Snapshots are Parquet directories
``<root>/snapshot_date=YYYY-MM-DD/version=<id>/table=<name>`` with a small table
``published`` beside the versions.  Listing, retention and mirror planning work
on *manifests*: DataFrames of ``(path, bytes, modified_at)``.  ``list_objects``
makes one with a ``binaryFile`` scan that reads no contents; its file index is
held by the driver, so for very many objects pass a stored manifest instead.  Deleting and copying objects is left to the
caller's filesystem client; these functions only say which.
"""

from __future__ import annotations

import datetime as dt
import uuid
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Fixed value: the local time zone the reference names its dump folders in.
SNAPSHOT_TZ = "Europe/Copenhagen"
DATE_IN_PATH = r"(\d{4}-\d{2}-\d{2})"


def snapshot_date(as_of: str | dt.datetime, tz: str = SNAPSHOT_TZ) -> str:
    """Local calendar date of a UTC instant (folder name of the export)."""
    t = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    if t.tzinfo is None:
        t = t.replace(tzinfo=dt.timezone.utc)
    return t.astimezone(ZoneInfo(tz)).date().isoformat()


def pinned(spark: SparkSession, paths: dict[str, str], as_of: str) -> dict[str, DataFrame]:
    """Each table as the files that were there at the UTC instant ``as_of``: the
    file names are fixed now, for all tables, and files modified after the
    instant are left out, so what is added while an export runs is in none of
    its tables.  (Tables whose files are replaced in place have no past; use
    ``BucketTable.read(version=...)`` for stored state.)"""
    instant = dt.datetime.fromisoformat(as_of)
    instant = instant.replace(tzinfo=dt.timezone.utc) if instant.tzinfo is None else instant
    # file times count milliseconds, the option counts seconds and excludes its own
    until = (instant.astimezone(dt.timezone.utc).replace(microsecond=0) + dt.timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S")
    out = {}
    for name, path in paths.items():
        there = spark.read.option("modifiedBefore", until).option("timeZone", "UTC").parquet(path)
        files = sorted(there.inputFiles())
        out[name] = (spark.read.schema(there.schema).option("basePath", path).parquet(*files)
                     if files else spark.createDataFrame([], there.schema))
    return out


def export(tables: dict[str, DataFrame], root: str, as_of: str, tz: str = SNAPSHOT_TZ,
           compression: str = "zstd") -> str:
    """K1: write every table for one ``as_of`` as a new version under its dated
    folder, check it (K2), and only then publish it as the folder's current
    version; an export that fails leaves the last good version in place.
    Returns the dated folder.

    Rows are counted while they are written, so the check needs no second
    scan.  Besides the version, ``pins`` names the files each table was read
    from (``pinned``), as they were before the first write."""
    folder = f"{root.rstrip('/')}/snapshot_date={snapshot_date(as_of, tz)}"
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    pins = [(name, file) for name, df in tables.items() for file in df.inputFiles()]
    spark.createDataFrame(pins, "table string, file string").write.parquet(f"{folder}/version={version}/pins")
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", compression).parquet(
            f"{folder}/version={version}/table={name}")
        counts[name] = seen.get["rows"]
        if not counts[name]:
            raise RuntimeError(f"snapshot table {name} is empty")
    number = len(_published(spark, folder)) + 1
    (spark.createDataFrame([(number, version, as_of, counts)], "number int, version string, as_of string, rows map<string,long>")
     .write.mode("append").parquet(f"{folder}/published"))
    return folder


def _published(spark: SparkSession, folder: str) -> list:
    """Published versions of one dated folder, oldest first (a row per export)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/published")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return spark.read.parquet(f"{folder}/published").orderBy("number", "version").collect()


def verify(tables_root: str, names: list[str], spark: SparkSession) -> dict[str, bool]:
    """K2 for tables that are there already: each must be non-empty, else the
    job fails (``export`` counts while it writes)."""
    out = {}
    for n in names:
        ok = not spark.read.parquet(f"{tables_root}/table={n}").isEmpty()
        if not ok:
            raise RuntimeError(f"snapshot table {n} is empty")
        out[n] = ok
    return out


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """Manifest of every file under ``root``: ``path, bytes, modified_at,
    snapshot_date`` (contents are not read)."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
         .select("path", "length", "modificationTime"))
    return manifest(f.select(F.col("path"), F.col("length").alias("bytes"),
                             F.col("modificationTime").cast("timestamp_ntz").alias("modified_at")))


def manifest(objects: DataFrame) -> DataFrame:
    """Add ``snapshot_date`` (from the path) to ``path, bytes, modified_at``."""
    d = F.regexp_extract(F.col("path"), DATE_IN_PATH, 1)
    return objects.withColumn("snapshot_date", F.to_date(F.nullif(d, F.lit(""))))


def latest(manifest_df: DataFrame) -> DataFrame:
    """Newest snapshot (by date, then modification time)."""
    return manifest_df.orderBy(F.col("snapshot_date").desc(), F.col("modified_at").desc(),
                               F.col("path").desc()).limit(1)


def expired(manifest_df: DataFrame, as_of, days: int) -> DataFrame:
    """K3: objects modified more than ``days`` days before ``as_of``
    (exactly ``days`` old is kept)."""
    end = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return manifest_df.where(F.col("modified_at") < end - F.make_dt_interval(days=F.lit(days)))


def mirror_plan(source: DataFrame, target: DataFrame, key: str = "rel_path") -> DataFrame:
    """K4: per source object ``copy`` when the target lacks it or holds a
    different size (or hash, if both manifests carry ``hash``), else
    ``skip``.  Objects only at the target are left alone (no delete)."""
    t_cols = [F.col(key), F.col("bytes").alias("_tb")]
    has_hash = "hash" in source.columns and "hash" in target.columns
    if has_hash:
        t_cols.append(F.col("hash").alias("_th"))
    j = source.join(target.select(*t_cols), key, "left")
    differs = F.col("_tb").isNull() | (F.col("_tb") != F.col("bytes"))
    if has_hash:
        differs = differs | ~F.col("_th").eqNullSafe(F.col("hash"))
    action = F.when(F.col("_tb").isNull(), F.lit("copy_new")).when(differs, F.lit("overwrite")) \
        .otherwise(F.lit("skip"))
    return j.select(*source.columns, action.alias("action"))


def counts(spark: SparkSession, root: str, date: str) -> DataFrame:
    """``(table, rows)`` of the published version, as counted while writing."""
    last = _published(spark, f"{root.rstrip('/')}/snapshot_date={date}")[-1]
    return spark.createDataFrame(sorted(last["rows"].items()), "table string, rows long")


def restore(spark: SparkSession, root: str, date: str, names: list[str],
            register: bool = True) -> dict[str, DataFrame]:
    """K5: load one snapshot's published tables back (and register them as views)."""
    folder, out = f"{root.rstrip('/')}/snapshot_date={date}", {}
    version = _published(spark, folder)[-1]["version"]
    for n in names:
        df = spark.read.parquet(f"{folder}/version={version}/table={n}")
        if register:
            df.createOrReplaceTempView(n)
        out[n] = df
    return out
