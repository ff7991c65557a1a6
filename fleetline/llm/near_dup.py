"""Near-duplicate documents by BagMinHash.

A document is a multiset of five-word shingles.  Every shingle of weight w owns
Poisson processes over its discretised weight: one per dyadic weight interval
(0,1], (1,2], (2,4], ... below w, with the interval's length as rate.  A point
has a time, a register and a weight level, and counts if its level is within
w.  Each register keeps its earliest point, so two documents agree in a
register with a probability equal to their weighted Jaccard similarity.
Points come in time order and a process ends once it is later than the last
register, which is what makes it quick.

Signatures are banded; texts that are equal word for word are one class from
the start.  In each bucket every member is compared with the bucket's least
member (a star, not all pairs), the links make components, and only where a
bucket still holds several components are its members compared across them,
in pairs of bounded blocks that emit only links which join components.  Every
comparison counts the whole texts' multisets.

Defined results: a null or empty text has no shingle and is alone in its class;
a text of fewer than five words is one shingle; repeated rows share a class;
rows of one doc_id are one document; a null doc_id has a null class; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, connected_components, mix64

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
BATCH_WORDS = 400_000
CACHED_WORDS = 300_000
BLOCK = 512

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of joined texts: (text number, 64-bit hash), a short text as one."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    number = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))  # words from here to the text's end
    at = np.flatnonzero((left >= size) | (np.arange(len(words)) == starts[number]))
    h = np.zeros(len(at), U64)
    padded = np.r_[words, np.zeros(size, U64)]
    for k in range(size):
        h += np.where(left[at] > k, padded[at + k] * _ODD[k], U64(k))
    return number[at], mix64(h)


def bag_minhash(number: np.ndarray, shingles: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Signatures (texts x registers) of the multisets given as (text, shingle) rows."""
    order = np.lexsort((shingles, number))
    number, shingles = number[order], shingles[order]
    first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (shingles[1:] != shingles[:-1])]) if len(number) else np.empty(0, int)
    weight = np.diff(np.r_[first, len(number)])
    number, shingles = number[first], shingles[first]
    parts = [(number, shingles, weight, np.zeros(len(number), np.int64), np.ones(len(number)))]
    low = 1
    while (more := weight > low).any():
        seed = mix64(shingles[more] + _ODD[:1] * U64(low))
        parts.append((number[more], seed, weight[more], np.full(int(more.sum()), low, np.int64), np.full(int(more.sum()), float(low))))
        low *= 2
    doc, seed, weight, base, rate = (np.concatenate(p) for p in zip(*parts, strict=True))
    time = np.zeros(len(doc))
    regs = np.full(texts * registers, np.inf)
    latest = np.full(texts, np.inf)
    turn = 0
    while len(doc):
        turn += 1
        h = mix64(seed + _ODD[1:2] * U64(turn))
        time = time - np.log(((h >> U64(11)).astype(float) + 1.0) * 2.0**-53) / rate
        live = time < latest[doc]
        if not live.all():
            doc, seed, weight, base, rate, time, h = (x[live] for x in (doc, seed, weight, base, rate, time, h))
        g = mix64(h ^ _ODD[2])
        level = base + 1 + ((g & U64(0xFFFFFFFF)).astype(float) * 2.0**-32 * rate).astype(np.int64)
        taken = level <= weight
        slot = doc * registers + ((g >> U64(32)) % U64(registers)).astype(np.int64)
        np.minimum.at(regs, slot[taken], time[taken])
        if len(doc):
            latest = regs.reshape(texts, registers).max(axis=1)
    return regs.reshape(texts, registers)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signatures).view(U64).reshape(len(signatures), bands, rows)
    h = np.broadcast_to(mix64(np.arange(1, bands + 1).astype(U64)), bits.shape[:2]).copy()
    for k in range(rows):
        h = mix64(h * _ODD[3] + bits[:, :, k])
    return h.view(np.int64)


def document_signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows ``(doc_id, content, n, keys)``: a digest of the words, the number of
    shingles and the band keys (none for a text without words)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()

        def out(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts])
            words = np.array([cache[w] for t in texts for w in t], U64)
            number, shingles = shingle_hashes(words, lengths)
            keys = band_keys(bag_minhash(number, shingles, len(texts), bands * rows), bands, rows)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([xxhash.xxh3_128_digest(" ".join(t)) for t in texts], pa.binary()),
                pa.array(np.bincount(number, minlength=len(texts)), pa.int64()),
                pa.array([k.tolist() if n else [] for k, n in zip(keys, lengths, strict=True)], pa.list_(pa.int64()))],
                ["doc_id", "content", "n", "keys"])

        for b in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").split()
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held > BATCH_WORDS:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield out(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, content binary, n long, keys array<long>")


def shingle_counts(text: str) -> Counter:
    w = text.split()
    return Counter([" ".join(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]) if w else Counter()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 0.0


def compare_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows ``(a, b, similarity)``: the exact weighted Jaccard of each pair's whole texts."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = None, Counter()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for i, ta, tb in zip(a, batch.column(2), batch.column(3), strict=True):
                if i != held:  # rows come sorted by a from a merge join, and are right in any order
                    held, counts = i, shingle_counts(ta.as_py() or "")
                found.append(weighted_jaccard(counts, shingle_counts(tb.as_py() or "")))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


def links_across(ids: list[int], classes: list[int], texts: list[str], similarity: float) -> list[tuple[int, int]]:
    """Links of at least ``similarity`` that join different classes of one block,
    without those that others imply.  Overlaps of a text with all others are
    summed over the shingles' postings."""
    words = [(t or "").split() for t in texts]
    cache = WordHash()
    flat = np.array([cache[w] for t in words for w in t], U64)
    number, shingles = shingle_hashes(flat, np.array([len(t) for t in words]))
    order = np.lexsort((number, shingles))
    number, shingles = number[order], shingles[order]
    first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (shingles[1:] != shingles[:-1])])
    weight = np.diff(np.r_[first, len(number)])
    number, shingles = number[first], shingles[first]  # postings: by shingle, then text
    size = np.bincount(number, weights=weight, minlength=len(ids))
    starts = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
    length = np.diff(np.r_[starts, len(shingles)])
    of = np.repeat(np.arange(len(starts)), length)
    mine = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[mine], np.arange(len(ids) + 1))
    root = {c: c for c in classes}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for i in range(len(ids)):
        own = mine[edges[i]:edges[i + 1]]
        n = length[of[own]]
        if not len(own):
            continue
        at = np.repeat(starts[of[own]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(number[at], weights=np.minimum(np.repeat(weight[own], n), weight[at]), minlength=len(ids))
        near = np.flatnonzero(both >= similarity * (size[i] + size - both) - 1e-9)
        for j in near[near > i].tolist():
            a, b = top(classes[i]), top(classes[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def compare_mixed(shared: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between members of one bucket that are in different
    components.  A bucket is cut into blocks of ``BLOCK`` members and its pairs
    of blocks are dealt out, so a task holds two blocks and emits fewer links
    than members.  Of buckets with the same members one is compared."""
    placed = shared.join(classes.select(F.col("id").alias("doc_id"), "class_id"), "doc_id", "left").withColumn(
        "class_id", F.coalesce("class_id", "doc_id"))
    # the least member was compared with all others before
    other = F.when(F.col("doc_id") > F.col("lead"), F.col("class_id"))
    mixed = placed.groupBy("key").agg(
        F.count("*").alias("n"), F.min(other).alias("x"), F.max(other).alias("y"),
        F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members")).where("x < y").groupBy("n", "members").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = placed.join(mixed.select("key", blocks.alias("blocks")), "key").select(
        "key", "doc_id", "class_id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "doc_id", "class_id")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("doc_id").sort_values("doc_id")
        found = links_across(block["doc_id"].tolist(), block["class_id"].tolist(), block["text"].tolist(), similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.join(texts, "doc_id").groupBy("key", "p", "q").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows ``(doc_id, class_id)`` for every document; the class is named by its least doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = checkpointed(document_signatures(docs, bands, rows))
    some = signed.where("doc_id is not null and n > 0")
    copies = some.groupBy("content").agg(F.min("doc_id").alias("rep"))
    keyed = some.select("doc_id", "content", "keys").join(copies, "content")
    rep_of = keyed.select("doc_id", "rep")
    members = keyed.where("doc_id = rep").select("doc_id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last")
    shared = checkpointed(members.join(buckets.select("key", "lead"), "key").distinct())
    asked = shared.select("doc_id").distinct()
    texts = checkpointed(docs.join(asked, "doc_id"))  # only of documents that share a bucket
    stars = shared.where("doc_id > lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = checkpointed(compare_pairs(stars, texts).where(F.col("similarity") >= similarity).select("a", "b"))
    classes = connected_components(links)
    more = checkpointed(compare_mixed(shared, classes, texts, similarity))
    if not more.isEmpty():
        classes = connected_components(links.unionAll(more))
    named = rep_of.join(classes.select(F.col("id").alias("rep"), "class_id"), "rep", "left").select(
        "doc_id", F.coalesce("class_id", "rep").alias("class_id"))
    # rows of one doc_id with several texts are one document
    named = named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select("doc_id").join(named, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def miss_rate(similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that a pair of this similarity shares no band."""
    return math.pow(1 - similarity**rows, bands)
