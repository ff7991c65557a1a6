"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches.  The hashes of a batch's long lines, one row a hash
with the number of documents and the greatest doc_id, are merge-joined with the
runs kept so far.  Hashes that no run holds are the batch's own new run; the
others only add to the counts of a hash that an earlier run brought in, and are
kept apart as increments.  So every hash is in exactly one run: when a level
has ``FANOUT`` runs they are compacted into one run of the next level by
writing them together, without any aggregation.  Runs are Parquet tables
bucketed and sorted by hash: a batch is shuffled to the buckets once, the runs
are read where they are, and no run is shuffled for a join.

Lines found in ``min_docs`` documents are then the run rows that alone reach it
and the hashes with increments; only these are added up.  Their places come
from the stored line table, are gathered per document and meet the texts in one
join by document.

Bounds: per level less than ``FANOUT`` runs, so a batch meets at most
``FANOUT`` x levels of them; a task holds the lines of one document.  A line in
a third of all documents is one row per task before any shuffle; its places are
one key of the join with the dropped lines, whose other side adaptive execution
broadcasts when small and whose hot partitions it splits.

A line's key is the line stripped of blanks and with A-Z lower-cased; keys
compare by MD5 (128 bits).  Defined results: null and empty texts are one empty
line; a document is a row: rows that repeat a doc_id count each, and those of
the greatest doc_id all keep the line; a null doc_id is less than all others;
a text whose lines all go is empty; an empty table has no rows; other columns
pass through untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, shared_folder

MIN_CHARS, MIN_DOCS = 40, 5
FANOUT, BATCHES = 4, 6
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped and lower-cased; ``lower`` is the faster one on ASCII lines."""
    def lowered(s: Column) -> Column:
        return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, _UPPER, _LOWER))
    return lowered(F.btrim(line, F.lit(BLANKS)))


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Per line the MD5 of its key, null for short ones."""
    def one(line: Column) -> Column:
        return bind(line_key(line), lambda key: F.when(F.char_length(key) >= min_chars, F.md5(key.cast("binary"))))
    return F.transform(lines_of(text), one)


class LineRuns:
    """Runs of line hashes under ``folder``, a path all executors see."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []  # names of the runs, level by level
        self.batches: list[str] = []  # tables of the batches, with their increments
        self._id, self._made = uuid.uuid4().hex, 0

    def _stored(self, rows: DataFrame, dealt: bool = False) -> str:
        """``rows`` as a bucketed, sorted table; ``known`` parts increments from new hashes."""
        name = f"line_run_{self._id}_{self._made}"
        self._made += 1
        rows = rows if dealt else rows.repartition(self.buckets, "hash")
        (rows.write.mode("overwrite").format("parquet").partitionBy("known").bucketBy(self.buckets, "hash").sortBy("hash")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not known").select("hash", "n_docs", "top")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: rows ``(doc_id, hashes)``.  Meets the runs, adds its own."""
        found = batch.select("doc_id", F.explode(F.array_distinct(F.array_compact("hashes"))).alias("hash"))
        # this grouping deals the batch to the buckets of the runs, so none of them is shuffled
        keys = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top"))
        known = F.lit(False)
        for i, name in enumerate(self.runs()):
            old = self.spark.table(name).where("not known").select("hash", F.lit(True).alias(f"in{i}"))
            keys = keys.join(old.hint("merge"), "hash", "left")
            known = known | F.coalesce(f"in{i}", F.lit(False))
        name = self._stored(keys.select("hash", "n_docs", "top", known.alias("known")), dealt=True)
        self.batches.append(name)
        self._place(name, 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            rows = self._run(full[0])
            for other in full[1:]:
                rows = rows.unionAll(self._run(other))
            self._place(self._stored(rows.withColumn("known", F.lit(False))), level + 1)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The hashes of ``batch`` (rows with ``hash``) that no run holds."""
        for name in self.runs():
            batch = batch.join(self._run(name).select("hash").hint("merge"), "hash", "left_anti")
        return batch

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """``(hash, n_docs, top)`` of the hashes in at least ``min_docs`` documents."""
        runs = None
        for name in self.runs():
            runs = self._run(name) if runs is None else runs.unionAll(self._run(name))
        if runs is None:
            return self.spark.createDataFrame([], "hash string, n_docs long, top long")
        more = None
        for name in self.batches:
            rows = self.spark.table(name).where("known").select("hash", "n_docs", "top")
            more = rows if more is None else more.unionAll(rows)
        more = more.groupBy("hash").agg(F.sum("n_docs").alias("m"), F.max("top").alias("later"))
        # a hash without increments counts only if its run row alone is enough
        every = runs.join(more, "hash", "left").select(
            "hash", (F.col("n_docs") + F.coalesce("m", F.lit(0))).alias("n_docs"), F.greatest("top", "later").alias("top"))
        return every.where(F.col("n_docs") >= min_docs)

    def forget(self) -> None:
        """Drops the tables' names; the files stay in the folder."""
        for k in range(self._made):
            self.spark.sql(f"DROP TABLE IF EXISTS line_run_{self._id}_{k}")


def common_lines(docs: DataFrame, folder: str, batches: int = BATCHES, min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """``(doc_id, text_hash, places)``: per document the lines (from 0) that go.
    Rows of one doc_id and one text share their row.  ``folder`` takes the line
    table, the runs and the frequent lines."""
    spark = docs.sparkSession
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                        line_hashes(F.col("text"), min_chars).alias("hashes"))
    batch = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(f"{folder}/lines")
    kept = spark.read.schema("doc_id long, text_hash long, hashes array<string>, batch int").parquet(f"{folder}/lines")
    store = LineRuns(spark, folder, fanout=fanout)
    for b in range(batches):
        store.add(kept.where(F.col("batch") == b).select("doc_id", "hashes"))
    store.frequent(min_docs).select("hash", "top").write.parquet(f"{folder}/frequent")
    store.forget()
    frequent = spark.read.schema("hash string, top long").parquet(f"{folder}/frequent")
    places = kept.select("doc_id", "text_hash", F.posexplode("hashes").alias("place", "hash")).where("hash is not null")
    gone = places.join(frequent, "hash").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def drop_common_lines(docs: DataFrame, folder: str | None = None, batches: int = BATCHES, min_docs: int = MIN_DOCS,
                      min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``kept_text, kept_lines, dropped_lines`` added: the text
    without its common lines, and both line counts."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    gone = common_lines(docs, folder, batches, min_docs, min_chars, fanout).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("places").alias("_places"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    d = docs.join(gone, own, "left")

    def rest(lines: Column) -> Column:
        """What lies between the places that go, slice by slice."""
        n = F.size("_places")
        before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("_places", k - 1))
        after = lambda k: F.when(k == n, F.size(lines)).otherwise(F.get("_places", k))
        return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(lines, before(k) + 2, after(k) - before(k) - 1)))

    dropped = F.coalesce(F.size("_places"), F.lit(0)).cast("long")
    text = F.when(F.col("_places").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        bind(lines_of(F.col("text")), lambda lines: F.array_join(rest(lines), "\n")))
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    return d.select(*[docs[c] for c in docs.columns if c not in ("kept_text", "kept_lines", "dropped_lines")],
                    text.alias("kept_text"), (n_lines - dropped).alias("kept_lines"), dropped.alias("dropped_lines"))


def line_digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", (F.col("kept_lines") + F.col("dropped_lines")).alias("n_lines"), F.col("dropped_lines").alias("n_dropped"),
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
