"""Integer k-means whose assignments are pruned by a LAESA pivot table.

Each vector becomes integers, and its distances to a fixed set of pivots are
computed once and stored with it.  In every round the driver holds the
centroids (``k`` rows) and their distances to the same pivots; for a vector and
a centroid the largest difference of their pivot distances is a lower bound of
their distance (triangle inequality).  Centroids are visited by ascending bound
and only those whose bound does not exceed the best distance so far receive an
exact integer distance, so results are those of comparing all of them.

A round is one narrow scan of the stored table: each partition sends ``k``
partial sums, Spark adds them per centroid as decimals, and ``k`` rows reach
the driver.  No vector is shuffled, so a very common vector is no hot key.

Bounds: pivots and centroids are parameters (16 and 8 vectors); a task holds
one Arrow batch.  The bounds are floats lowered by one part in 10^9 of the
distances they come from, far above the rounding error, so no nearest centroid
is missed.

Defined results: vectors that are null, not of the given length or with a null,
infinite or NaN component are left out; rows of one vec_id are vectors of their
own (ties of the start order: by components); a null vec_id starts as the empty
text; with fewer vectors than centroids there are fewer centroids; equal
distances go to the smaller number; an empty table has no rows; other columns
are ignored.  A component of 2^27 or more after scaling would not leave a
distance that a long holds: such a vector raises an error that names its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

K, ROUNDS, DIMENSIONS, PIVOTS = 8, 10, 64, 16
SCALE, LIMIT, SEED = 1024, 1 << 27, 3
MARGIN = 1e-9


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, vector)``: kept vectors as little-endian 32-bit integers."""
    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            whole = np.asarray(lists.is_valid()) & (np.asarray(lists.value_lengths().fill_null(-1)) == dimensions)
            lists, ids = lists.filter(pa.array(whole)), b.column(0).filter(pa.array(whole))
            flat = lists.flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dimensions)
            good = np.isfinite(x).all(axis=1)
            x, ids = np.floor(x[good] * SCALE), ids.filter(pa.array(good))
            large = np.abs(x).max(axis=1, initial=0) >= LIMIT
            if large.any():
                raise ValueError(f"vec_id {ids[int(large.argmax())]}: a component is {LIMIT / SCALE:.0f} or more")
            yield pa.RecordBatch.from_arrays([ids, _packed(x.astype("<i4"))], ["vec_id", "vector"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(scaled, "vec_id long, vector binary")


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of int64 ``x`` to rows of ``c``, pair by pair."""
    return np.square(x - c).sum(axis=-1)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with ``to_pivots``: the distance to each pivot, as doubles."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unpacked(b.column(1), "<i4").astype(np.int64)
                far = np.stack([np.sqrt(_squared(x, p).astype(float)) for p in pivots], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(far.astype("<f8"))], ["vec_id", "vector", "to_pivots"])

    return vectors.mapInArrow(measured, "vec_id long, vector binary, to_pivots binary")


def nearest(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and how many exact
    distances that took.  ``far``: distances of the rows to the pivots."""
    rows, k = len(x), len(centroids)
    bound = np.zeros((rows, k))
    for c in range(k):
        from_pivots = np.sqrt(_squared(centroids[c], pivots).astype(float))
        bound[:, c] = (np.abs(far - from_pivots) - MARGIN * (far + from_pivots)).max(axis=1, initial=0)
    order = np.argsort(bound, axis=1, kind="stable")
    best, who, exact = np.full(rows, np.iinfo(np.int64).max), np.zeros(rows, np.int64), 0
    left = np.arange(rows)
    for turn in range(k):
        c = order[left, turn]
        # bounds ascend, so a row whose next bound is too large is done
        near = bound[left, c] <= np.sqrt(best[left].astype(float)) * (1 + MARGIN)
        left, c = left[near], c[near]
        d = _squared(x[left], centroids[c])
        exact += len(left)
        better = (d < best[left]) | ((d == best[left]) & (c < who[left]))
        best[left[better]], who[left[better]] = d[better], c[better]
    return who, best, exact


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unpacked(b.column(1), "<i4").astype(np.int64)
                who, best, _ = nearest(x, _unpacked(b.column(2), "<f8"), centroids, pivots)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, "vec_id long, cluster int, distance long")


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list:
    """Per centroid the count and exact component sums of its vectors, and the
    number of exact distances taken."""
    dimensions = centroids.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's sums stay below 2^63 up to 2^36 vectors
        total, count, exact = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64), 0
        for b in batches:
            if b.num_rows:
                x = _unpacked(b.column(1), "<i4").astype(np.int64)
                who, _, n = nearest(x, _unpacked(b.column(2), "<f8"), centroids, pivots)
                for c in range(len(centroids)):
                    total[c] += x[who == c].sum(axis=0)
                count += np.bincount(who, minlength=len(centroids))
                exact += n
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(centroids)), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.int64())),
            pa.array(np.r_[exact, np.zeros(len(centroids) - 1, np.int64)])], ["cluster", "n", "total", "exact"])

    parts = table.mapInArrow(add, "cluster int, n long, total array<long>, exact long")
    return parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("exact").alias("exact"),
        F.array(*[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(dimensions)]).alias("total")).collect()


def centroid_clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
                      pivots: int = PIVOTS, seed: int = SEED) -> tuple[DataFrame, list[list[int]], list[int]]:
    """``(vec_id, cluster, distance)`` of every kept vector, the final
    centroids, and the exact distances each round took."""
    vectors = checkpointed(integer_vectors(embeddings, dimensions))
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.orderBy(start, "vector").select("vector").limit(max(k, pivots)).collect()
    if not first:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    held = np.stack([np.frombuffer(bytes(r["vector"]), "<i4") for r in first]).astype(np.int64)
    fixed, centroids = held[:pivots], held[:k]
    table, work = checkpointed(pivot_table(vectors, fixed)), []
    for _ in range(rounds):
        centroids, done = centroids.copy(), _sums(table, centroids, fixed)
        for r in done:
            if r["n"]:
                centroids[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
        work.append(sum(r["exact"] for r in done))
    return checkpointed(_assigned(table, centroids, fixed)), centroids.tolist(), work


def cluster_digests(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """With the distance summed per cluster and over all, and each centroid's
    digest: one row a centroid, so these sums may pass through the driver."""
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return assigned.select(
        "vec_id", "cluster", "distance", at([sums.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), at(names, "string").alias("centroid_sha256"))
