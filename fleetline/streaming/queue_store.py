"""The event queue as stored tables: open events apart from finished ones.

``state`` holds the queue rows (with the order columns of ``queue.fold``) in two
parts, ``open`` (queued, processing) and ``terminal`` (done, dead), bucketed by
id.  ``keys`` maps each key ``(sn, event_ts)`` to its id, bucketed by the folded
key, so a re-sent event finds its old id without reading any queue row.

* A writer tick reads the open part only.  It rewrites the open buckets its ids
  are in and adds the finished rows to the terminal part, which it never reads:
  a queue with any number of finished events costs a tick the same.
* A batch of arrivals reads the key buckets it touches.  New events are added
  to open buckets without reading them; only re-sent events rewrite the buckets
  they sit in.
* ``compact`` joins buckets that have become many small files.

Every write is one version of a ``BucketTable`` with the batch it finishes, so
a batch or tick that runs again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.operators import queue
from fleetline.operators.state import plain, sn_key
from fleetline.session import ensure_semantics
from fleetline.sources.buckets import BUCKET, PART, BucketTable, columns, with_bucket

OPEN, TERMINAL = "open", "terminal"

ARRIVALS = "seq long, received_at timestamp_ntz, sn string, event_ts timestamp_ntz, payload string"
TRANSITIONS = (
    "id long, at timestamp_ntz, seq long, status string, attempts int, next_at timestamp_ntz, reason string")
STATE = (
    "id long, source string, sn string, event_ts timestamp_ntz, payload string, status string, attempts int, "
    "next_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, created_raw timestamp_ntz, "
    "last_arrival_at timestamp_ntz, last_arrival_seq long, next_raw timestamp_ntz, "
    "last_order struct<at:timestamp_ntz,src:int,seq:long>")
KEYS = "sn string, event_ts timestamp_ntz, id long"


class QueueStore:
    """The queue under ``root``; ``buckets`` is fixed when it is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        ensure_semantics(spark)
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.state = BucketTable(spark, f"{self.root}/state", STATE, buckets)
        self.keys = BucketTable(spark, f"{self.root}/keys", KEYS, buckets)

    # -------------------------------------------------------------- reading
    def open_events(self) -> DataFrame:
        return self.state.read([OPEN])

    def table(self) -> DataFrame:
        """The whole queue, as ``queue.fold`` gives it."""
        return self.state.read().drop(*queue.STATE_COLUMNS, PART, BUCKET)

    def depth(self, as_of) -> DataFrame:
        return queue.depth(self.state.read().select("status", "next_at"), as_of)

    def lag(self, as_of) -> DataFrame:
        """Q10 from the open part alone."""
        return queue.lag(self.open_events(), as_of)

    # -------------------------------------------------------------- writing
    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        part = F.when(F.col("status").isin(*queue.OPEN), F.lit(OPEN)).otherwise(F.lit(TERMINAL))
        return rows.withColumn(PART, part).withColumn(BUCKET, self._bucket())

    def _buckets_of(self, ids: DataFrame) -> list[int]:
        return sorted(r[0] for r in ids.select(self._bucket()).distinct().collect())

    def _where(self, ids: DataFrame, parts: list[str]) -> dict[str, list[int]]:
        """Part and buckets in which the given ids sit (at most the number of buckets)."""
        buckets = self._buckets_of(ids)
        if not buckets:
            return {}
        inside = self.state.read(parts, buckets).select("id", PART, BUCKET).join(ids.select("id"), "id", "left_semi")
        found: dict[str, list[int]] = {}
        for r in inside.select(PART, BUCKET).distinct().collect():
            found.setdefault(r[PART], []).append(r[BUCKET])
        return found

    def _change(self, ids: DataFrame, where: dict[str, list[int]], arrivals: DataFrame, transitions: DataFrame | None,
                feed: str, batch: int) -> None:
        """Folds the rows of ``ids`` with what happened to them and replaces the
        buckets they sit in; rows of new ids are added."""
        held = self.state.read_at(where)
        prev = held.join(ids.select("id"), "id", "left_semi").drop(PART, BUCKET)
        folded = self._placed(queue.fold(arrivals, transitions, keep_order_columns=True, prev=prev))
        rest = held.join(ids.select("id"), "id", "left_anti")
        self.state.publish(rest.unionByName(folded.select(*rest.columns)), where, feed, batch)

    def enqueue(self, arrivals: DataFrame, batch: int) -> None:
        """A batch of accepted webhooks (``seq, received_at, sn, event_ts,
        payload``), numbered upwards in the order of arrival; one that is done
        is skipped.  The batch is held while its steps run."""
        if self.state.is_done("arrivals", batch):
            return
        a = arrivals.select(*columns(ARRIVALS)).persist()
        first = a.groupBy(sn_key("sn").alias("_k"), "event_ts").agg(F.min_by("sn", "seq").alias("sn"), F.min("seq").alias("id"))
        first = with_bucket(first.select(plain("sn").alias("sn"), "event_ts", "id"), self.buckets, sn_key("sn"), "event_ts").persist()
        try:
            touched = sorted(r[0] for r in first.select(BUCKET).distinct().collect())
            if not self.keys.is_done("arrivals", batch):
                new = first.join(self._keys_at(touched), self._same(first), "left_anti")
                self.keys.publish(new.withColumn(PART, F.lit("all")), feed="arrivals", batch=batch)
            # an id is the seq of its first arrival: keys with another id came before
            resent = first.join(self._keys_at(touched), self._same(first)).where("_id <> id").select(F.col("_id").alias("id"))
            where = self._where(resent, [OPEN, TERMINAL])
            self._change(resent, where, a, None, "arrivals", batch)
        finally:
            first.unpersist()
            a.unpersist()

    def _keys_at(self, buckets: list[int]) -> DataFrame:
        return self.keys.read(buckets=buckets).select(sn_key("sn").alias("_k"), F.col("event_ts").alias("_e"), F.col("id").alias("_id"))

    @staticmethod
    def _same(rows: DataFrame):
        return (sn_key(rows["sn"]) == F.col("_k")) & (rows["event_ts"] == F.col("_e"))

    def apply(self, transitions: DataFrame, feed: str, batch: int) -> None:
        """Writer actions on queue ids: claims, completions, failures.  Only ids
        that are not open are looked for among the finished ones."""
        if self.state.is_done(feed, batch):
            return
        t = transitions.select(*columns(TRANSITIONS)).persist()
        try:
            ids = t.select("id").distinct()
            where = self._where(ids, [OPEN])
            missing = ids.join(self.state.read_at(where).select("id"), "id", "left_anti")
            if not missing.isEmpty():
                where = {**where, **self._where(missing, [TERMINAL])}
            self._change(ids, where, self.spark.createDataFrame([], ARRIVALS), t, feed, batch)
        finally:
            t.unpersist()

    def tick(self, as_of, limit: int = queue.DEFAULT_BATCH) -> DataFrame:
        """Q8: the transitions of one writer tick, from the open events alone."""
        return queue.drain(self.open_events(), as_of, limit)

    def compact(self, most: int = 16) -> None:
        """Rewrites buckets of more than ``most`` pieces as one file each."""
        for table in (self.state, self.keys):
            many = {p: bs for p, bs in table.crowded(table.manifest(), most).items() if bs}
            if many:
                table.publish(table.read_at(many), many)
