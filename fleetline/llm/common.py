"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a given table, read through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; a
    scratch folder is set only where the session names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fleetline-llm-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it a Python task is handed at most ``rows`` rows at a time: with
    two texts in a row the usual 10,000 take an executor's memory."""
    name, spark_conf = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf
    before = spark_conf.get(name, None)
    spark_conf.set(name, str(rows))
    try:
        yield
    finally:
        spark_conf.unset(name) if before is None else spark_conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it Spark drops the shuffle files of a plan as soon as its action
    has ended.  Else they stay until the driver collects garbage, which a driver
    with little to do may not do for hours.  Only for frames whose lineage is
    cut: a plan that runs again shuffles again."""
    name, spark_conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.conf
    before = spark_conf.get(name, None)
    spark_conf.set(name, "true")
    try:
        yield
    finally:
        spark_conf.unset(name) if before is None else spark_conf.set(name, before)


def kept_columns(docs: DataFrame, keep: tuple[str, ...]) -> Column:
    """Columns that pass through an operator untouched, as one struct ``kept``;
    the text is not among them, as it passes as itself."""
    return F.struct(F.lit(True).alias("row"), *[docs[k] for k in keep if k != "text"]).alias("kept")


def with_kept(ddl: str, d: DataFrame, keep: tuple[str, ...]) -> StructType:
    """The given columns, ``kept`` as ``d`` has it, and the text if it is kept."""
    text = [d.schema["text"]] if "text" in keep else []
    return StructType([*StructType.fromDDL(ddl).fields, d.schema["kept"], *text])


def taken(keep: tuple[str, ...]) -> list[str]:
    """The kept columns of an operator's output, by name."""
    return [k if k == "text" else f"kept.{k}" for k in keep]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row: the optimizer
    does not copy an expression into the places where a lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of unsigned integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Classes of an undirected graph given as integer pairs: rows
    ``(id, class_id)`` for every id of an edge, ``class_id`` the least id.

    Alternating large-star and small-star steps, each one shuffle of the
    edges by vertex; the least neighbour is a partial aggregate, so a vertex
    with a third of all edges becomes one row per input partition before the
    shuffle, and the join that follows is one that adaptive execution splits.
    Every round is checkpointed and rounds end when nothing changes, which is
    read from one pair of sums.
    """
    e = checkpointed(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        # large star: every larger neighbour points to the least neighbour
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours and the vertex point to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("p")
        ).select("p.u", "p.v").where("u <> v").distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (now["n"], now["h"])
        if now == before:
            break
        before = now
    roots = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("class_id"))
    own = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("class_id"))
    return roots.unionAll(own.join(roots.select("id"), "id", "left_anti"))
