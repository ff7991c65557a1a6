"""Bucketed Parquet tables with versions, changed by copy-on-write of buckets.

Layout::

    <root>/data/stored_version=<n>/part=<p>/bucket=<b>/*.parquet
    <root>/manifest/<n>.json

A manifest names, for every part and bucket, the versions whose files hold its
rows.  Publishing version ``n`` writes only what changed and a manifest that
points to the old files for everything else; files never change after that, so
readers of an older manifest are not disturbed and a run that fails before its
manifest is there leaves nothing visible.  A manifest also keeps the last
finished batch of every feed, so a batch that runs again is seen as done.

The manifest grows with the number of buckets, not with the rows: choose the
buckets so that one of them is a good Parquet file (some hundred MB).  One
writer at a time; readers are free.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType, StringType

PART, BUCKET = "part", "bucket"


def with_bucket(df: DataFrame, buckets: int, *keys) -> DataFrame:
    """``df`` with the bucket of its keys: the partition that hash partitioning
    deals them to.  Unlike the hash functions it honours a collation, so keys
    that compare equal share a bucket."""
    return df.repartition(buckets, *keys).withColumn(BUCKET, F.spark_partition_id())


def columns(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class BucketTable:
    """A table under ``root`` with the columns of ``schema`` (a type or DDL)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.schema = StructType([f for f in schema.fields if f.name not in (PART, BUCKET)])

    # ------------------------------------------------------------- versions
    def versions(self) -> list[int]:
        folder, fs = _path(self.spark, f"{self.root}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """``{"version", "buckets", "entries": {part: {bucket: [versions]}}, "done": {feed: batch}}``"""
        have = self.versions()
        if version is None and not have:
            return {"version": -1, "buckets": self.buckets, "entries": {}, "done": {}}
        name = f"{self.root}/manifest/{have[-1] if version is None else version}.json"
        path, fs = _path(self.spark, name)
        stream = fs.open(path)
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if held["buckets"] != self.buckets:
            raise ValueError(f"{self.root} has {held['buckets']} buckets, not {self.buckets}")
        return held

    def is_done(self, feed: str, batch: int) -> bool:
        return self.manifest()["done"].get(feed, -1) >= batch

    # -------------------------------------------------------------- reading
    def files(self, held: dict, parts=None, buckets=None) -> list[str]:
        """The folders of the given parts and buckets (None: all)."""
        wanted = None if buckets is None else {str(b) for b in buckets}
        return sorted(
            f"{self.root}/data/stored_version={v}/{PART}={p}/{BUCKET}={b}"
            for p, by in held["entries"].items() if parts is None or p in parts
            for b, vs in by.items() if wanted is None or b in wanted for v in vs)

    def read(self, parts=None, buckets=None, version: int | None = None) -> DataFrame:
        """Rows with ``part`` and ``bucket``; only the named folders are listed and read."""
        return self._scan(self.files(self.manifest(version), parts, buckets))

    def read_at(self, where: dict[str, list[int]]) -> DataFrame:
        """The rows of some buckets of each part, in one scan."""
        held = self.manifest()
        return self._scan([f for part, buckets in where.items() for f in self.files(held, [part], buckets)])

    def _scan(self, folders: list[str]) -> DataFrame:
        full = StructType([*self.schema.fields, StructField(PART, StringType()), StructField(BUCKET, IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*folders).select(*full.names)

    # -------------------------------------------------------------- writing
    def publish(self, rows: DataFrame, replaced: dict[str, list[int]] | None = None, feed: str | None = None,
                batch: int | None = None) -> int:
        """A new version: ``rows`` (with ``part`` and ``bucket``) are all rows of
        the ``replaced`` buckets, and are added to the buckets not named there."""
        held = self.manifest()
        version = held["version"] + 1
        data = f"{self.root}/data/stored_version={version}"
        (rows.select(*self.schema.names, PART, BUCKET).repartition(PART, BUCKET)
         .write.mode("overwrite").partitionBy(PART, BUCKET).parquet(data))
        entries = {p: dict(by) for p, by in held["entries"].items()}
        for p, bs in (replaced or {}).items():
            for b in bs:
                entries.get(p, {}).pop(str(b), None)
        for p, b in self._written(data):
            entries.setdefault(p, {}).setdefault(b, [])
            entries[p][b] = [*entries[p][b], version]
        done = {**held["done"], **({feed: batch} if feed else {})}
        self._put(version, {"version": version, "buckets": self.buckets, "entries": entries, "done": done})
        return version

    def _written(self, data: str) -> list[tuple[str, str]]:
        folder, fs = _path(self.spark, data)
        found = []
        for part in fs.listStatus(folder):
            if part.isDirectory() and "=" in part.getPath().getName():
                for bucket in fs.listStatus(part.getPath()):
                    found.append((part.getPath().getName().split("=", 1)[1], bucket.getPath().getName().split("=", 1)[1]))
        return found

    def _put(self, version: int, held: dict) -> None:
        """The manifest appears whole: written beside, then renamed."""
        jvm_path = lambda p: _path(self.spark, p)[0]
        beside, name = f"{self.root}/manifest/.{version}.json.tmp", f"{self.root}/manifest/{version}.json"
        fs = _path(self.spark, beside)[1]
        out = fs.create(jvm_path(beside), True)
        try:
            out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        finally:
            out.close()
        if not fs.rename(jvm_path(beside), jvm_path(name)):
            raise RuntimeError(f"version {version} of {self.root} is there already: two writers")

    def crowded(self, held: dict, most: int = 16) -> dict[str, list[int]]:
        """Buckets made of more than ``most`` pieces, to be replaced by one."""
        return {p: sorted(int(b) for b, vs in by.items() if len(vs) > most) for p, by in held["entries"].items()}

    def unreferenced(self, keep: int = 2) -> list[str]:
        """Folders that none of the newest ``keep`` manifests names; the caller
        deletes them with its filesystem client."""
        have = self.versions()
        live = {f for v in have[-keep:] for f in self.files(self.manifest(v))}
        old = {f for v in have[:-keep] for f in self.files(self.manifest(v))} if keep > 0 else set()
        return sorted(old - live)
