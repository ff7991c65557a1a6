"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive normalised words of a benchmark item (a whole
item if it has fewer) is a pattern; each task builds the automaton once and
scans each normalised text once.  Normalising replaces byte by byte, so every
hit maps back to code-point offsets of the original text.

The windows are the only broadcast.  They are counted first: a benchmark of
more than ``MAX_WINDOWS`` windows is dealt into blocks by hash, one scan a
block, and the hits of a document are merged, so no task holds more.

Defined results: null or empty text has no words and no hit; an item without
words has no window; repeated items, repeated windows and repeated documents
are each reported; a null item_id counts as no item but its windows still hit;
an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, kept_columns, taken, with_kept

WINDOW = 10
MAX_WINDOWS = 500_000

# Kept bytes: digits, a-z and everything beyond ASCII; A-Z become a-z; the rest parts words.
_NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
                for b in range(256))

HITS = "doc_id long, uid long, n_words long, words array<struct<first:int,last:int>>, " \
       "spans array<struct<start:int,end:int>>, items array<string>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows ``(window, items)``: every distinct window and the items it is in."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ids = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if words else 0):
                    out.append(b" ".join(words[i:i + size]))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.string())], ["window", "item"])

    rows = bench.select(F.col("item_id").cast("string"), "text").mapInArrow(windows, "window binary, item string")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


_AUTOMATA: dict[int, ahocorasick.Automaton] = {}


def _automaton(held: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of windows, built once per worker.  A
    byte is one character; blanks around a window keep it to whole words."""
    key = held._path or id(held)
    if key not in _AUTOMATA:
        a = ahocorasick.Automaton()
        for window, items in held.value:
            a.add_word(f" {window.decode('latin-1')} ", (len(window) + 2, window.count(b" ") + 1, items))
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = a
    return _AUTOMATA[key]


def scan_text(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list, list, list]:
    """Word count, hit runs in words, the same in code points of the original, and items."""
    raw = (text or "").encode()
    plain = raw.translate(_NORMAL)
    words = plain.split()
    if not words or not len(automaton):
        return len(words), [], [], []
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return len(words), [], [], []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = np.searchsorted(blanks, np.array([end - m[0] + 1 for end, m in found]))
    marks = np.zeros(len(words) + 1, np.int32)
    np.add.at(marks, first, 1)
    np.add.at(marks, first + np.array([m[1] for _, m in found]), -1)
    edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(marks)[:-1] > 0, 0].astype(np.int8)))
    runs = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
    inside = np.r_[False, np.frombuffer(plain, np.uint8) != 32, False]
    turns = np.flatnonzero(inside[1:] != inside[:-1])  # byte starts and ends of the words, in turn
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    spans = [(int(points[turns[2 * i]]), int(points[turns[2 * j + 1]])) for i, j in runs]
    return len(words), runs, spans, sorted({x for _, m in found for x in m[2]})


def _scan(docs: DataFrame, windows: list, keep: tuple[str, ...]) -> DataFrame:
    """``docs`` (doc_id, uid, text, kept) with the hits of one block of windows."""
    held = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(held)
        pair = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
        for b in batches:
            got = [scan_text(t, automaton) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()),
                pa.array([[{"first": i, "last": j} for i, j in g[1]] for g in got], pair("first", "last")),
                pa.array([[{"start": i, "end": j} for i, j in g[2]] for g in got], pair("start", "end")),
                pa.array([g[3] for g in got], pa.list_(pa.string())), b.column(3),
                *([b.column(2)] if "text" in keep else [])], names)

    names = ["doc_id", "uid", "n_words", "words", "spans", "items", "kept"] + ["text"] * ("text" in keep)
    return docs.mapInArrow(scan, with_kept(HITS, docs, keep))


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW,
                       max_windows: int = MAX_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document ``(doc_id, n_words, n_hit, spans, items)``: words inside any
    occurrence of a window, their runs as code-point spans of the original
    text, and the items with an occurring window.  With ``keep``, these columns
    of ``docs`` instead of doc_id."""
    rows = benchmark_windows(bench, window)
    n = rows.count()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("uid"), "text", kept_columns(docs, keep))
    if n <= max_windows:
        hits = _scan(d, [(bytes(r["window"]), r["items"]) for r in rows.collect()], keep)
        runs = F.col("words")
    else:
        rows = checkpointed(rows)
        d = checkpointed(d.withColumn("uid", F.monotonically_increasing_id()))
        blocks = -(-n // max_windows) * 2  # room for uneven blocks
        hits = None
        for k in range(blocks):
            block = rows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect()
            part = _scan(d, [(bytes(r["window"]), r["items"]) for r in block], keep)
            hits = part if hits is None else hits.unionAll(part)
        hits = hits.groupBy("doc_id", "uid").agg(
            F.first("kept").alias("kept"), *[F.first("text").alias("text")] * ("text" in keep), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("words")).alias("words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        runs = merged(F.col("words"), "first", "last")
        hits = hits.select("doc_id", "kept", *["text"] * ("text" in keep), "n_words", runs.alias("words"), merged(F.col("spans"), "start", "end").alias("spans"),
                           F.sort_array(F.array_distinct("items")).alias("items"))
        runs = F.col("words")
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return hits.select(*taken(keep) or ["doc_id"], "n_words", n_hit.alias("n_hit"), "spans", "items")


def merged(runs, lo: str, hi: str):
    """Overlapping runs of one document as their union, in order."""
    kind = f"array<struct<{lo}:int,{hi}:int>>"
    return F.aggregate(
        F.sort_array(runs), F.array().cast(kind),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)[hi] >= r[lo]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.get(done, F.size(done) - 1)[lo].alias(lo),
                F.greatest(F.get(done, F.size(done) - 1)[hi], r[hi]).alias(hi))).cast(kind)),
        ).otherwise(F.concat(done, F.array(r).cast(kind))))


def contamination_digests(hits: DataFrame) -> DataFrame:
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
