"""Exact repeats of 100 bytes or more, by an enhanced suffix array in pieces.

Matches of 100 bytes need not be looked for everywhere at once: the least hash
among the 48-byte strings inside a 100-byte window (its anchor) is the same in
every occurrence, so suffixes are dealt out by anchor.  Consecutive windows
with one anchor form a block.

1. Blocks with equal content are one repeat; all but the first occurrence are
   removed whole.  Equal blocks of an input batch meet before the shuffle, so a
   passage on a third of all documents is a row per batch.
2. Where blocks share an anchor but differ (the edges of copied stretches),
   their first occurrences go, with their bytes, to an enhanced suffix array:
   suffixes sorted, common prefixes of neighbours, and one stack scan over the
   common-prefix intervals.  An interval whose occurrences have different left
   neighbours is a maximal repeat, given with all occurrences; all but the first
   are removed.  Blocks are cut in two halves that share 74 bytes or more, so a
   frequent short string does not gather its surroundings in one place.  Where
   a frequent line of 74 bytes or more still does (more than ``GROUP_ROWS``
   halves with one core), the halves are dealt out by each 100 bytes they hold,
   and all but the first place of equal 100 bytes are removed: the same bytes,
   as an interval of the array is the union of its 100-byte windows.
3. The spans of a document are merged and cut out of its bytes.

Blocks are compared by digests of 128 bits.  Order is by doc_id, then start.

Defined results: a null or empty text has no byte; rows of one doc_id must
repeat one text and are one document; a null doc_id is not matched and keeps all;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, mix64

LENGTH = 100
GRAM = 48
HALF = (LENGTH - GRAM) // 2
PIECE_BYTES = 2 << 20
ARRAY_ROWS = 4_000
GROUP_ROWS = 4_000

_BYTE = mix64(np.arange(1, 257).astype(U64) * U64(0x9E3779B97F4A7C15))
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    t = x * _A + y * _B
    t ^= t >> U64(31)
    return t


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 48 and the 100 bytes from every position with room for them."""
    h, size, by = _BYTE[data], 1, {}
    while size < 64:
        h, size = _joined(h[:-size], h[size:]), 2 * size
        by[size] = h
    gram = _joined(by[32][:len(data) - 47], by[16][32:])
    window = _joined(by[64][:len(data) - 99], by[32][64:][:len(data) - 99])
    window = _joined(window, by[4][96:][:len(window)])
    return mix64(gram), mix64(window)


def anchored_blocks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of joined texts: (start, windows, anchor offset, anchor hash, content hash)."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    gram, window = _rolling(data)
    # hash above, place below: the least is the least hash, leftmost among equals of one window
    room = U64(0xFFFFFFFF)
    packed = (gram & ~room) | np.arange(len(gram)).astype(U64)
    least, size, width = packed, 1, LENGTH - GRAM + 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = width - size
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    number = np.searchsorted(ends, np.arange(len(least)), side="right")
    at = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[number])
    if not len(at):
        return none, none, none, none, none
    anchor = (least[at] & room).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (number[at][1:] != number[at][:-1])])
    first, last = at[cut], np.r_[at[cut[1:] - 1], at[-1]]
    anchor = anchor[cut]
    content = mix64(window[first] * _A + window[last] + mix64(((last - first) << 8 | (anchor - first)).astype(U64)))
    return first, last - first + 1, anchor - first, gram[anchor].view(np.int64), content.view(np.int64)


BLOCKS = "anchor long, content long, doc_id long, place long"


def document_blocks(docs: DataFrame) -> DataFrame:
    """Rows ``(anchor, content, doc_id, place)``: ``place`` packs start, anchor
    offset and windows of a block.  Blocks that repeat an earlier one of the
    same batch are already removable; they leave as merged runs, with a start
    in ``content``, minus the length in ``place`` and any spread-out anchor."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []
            ids: list[int] = []
            texts: list[bytes] = []
            held = 0

            def take(ids=ids, texts=texts, parts=parts) -> None:
                ends = np.cumsum([len(t) for t in texts])
                first, n, offset, anchor, content = anchored_blocks(np.frombuffer(b"".join(texts), np.uint8), ends)
                of = np.searchsorted(ends, first, side="right")
                start = first - np.r_[0, ends][of]
                parts.append((anchor, content, np.array(ids, np.int64)[of], start << 16 | offset << 8 | (n - 1)))
                ids.clear()
                texts.clear()

            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if i is not None and len(raw) >= LENGTH:
                    ids.append(i)
                    texts.append(raw)
                    held += len(raw)
                    if held >= PIECE_BYTES:
                        take()
                        held = 0
            if ids:
                take()
            if not parts:
                continue
            anchor, content, doc, place = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((place, doc, content, anchor))
            anchor, content, doc, place = anchor[order], content[order], doc[order], place[order]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]
            same = np.r_[False, (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (anchor, content, doc, place)], ["anchor", "content", "doc_id", "place"])
            again = ~new & ~same
            if again.any():
                d, s = doc[again], place[again] >> 16
                e = s + (place[again] & 0xFF) + LENGTH
                d, s, e = merged_runs(d, s, e)
                spread = mix64(d.astype(U64) * _A + s.astype(U64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(s), pa.array(d), pa.array(s - e)], ["anchor", "content", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(blocks, BLOCKS)


def merged_runs(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each key; overlapping and touching ones are one."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    # ends are made to grow across keys so that one running maximum serves all
    lift = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.r_[True, start[1:] + lift[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(key) - 1]
    return key[at], start[at], reach[last] - lift[at]


FOUND = "doc_id long, at long, size int, offset int, anchor long"


def repeated_blocks(blocks: DataFrame) -> DataFrame:
    """Rows ``(doc_id, at, size, offset, anchor)``: removable stretches (offset
    -1), and first occurrences of blocks whose anchor other blocks share."""
    dealt = blocks.repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id", "place")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last block row
        rep = None  # the last first occurrence: anchor, doc, place, whether it has left
        for b in batches:
            anchor, content, doc, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            runs = place < 0
            out = [(doc[runs], content[runs], -place[runs], np.full(int(runs.sum()), -1), np.zeros(int(runs.sum()), np.int64))]
            anchor, content, doc, place = (x[~runs] for x in (anchor, content, doc, place))
            if len(anchor):
                head = before or (anchor[0] ^ 1, 0, 0, 0)
                pa_, pc, pd_, pp = (np.r_[np.array([h], np.int64), x[:-1]] for h, x in zip(head, (anchor, content, doc, place), strict=True))
                new = (anchor != pa_) | (content != pc)
                again = ~new & ((doc != pd_) | (place != pp))
                before = (anchor[-1], content[-1], doc[-1], place[-1])
                out.append((doc[again], place[again] >> 16, (place[again] & 0xFF) + LENGTH, np.full(int(again.sum()), -1), np.zeros(int(again.sum()), np.int64)))
                at = np.flatnonzero(new)
                if len(at):
                    a, d, p = anchor[at], doc[at], place[at]
                    gone = np.zeros(len(a), bool)
                    if rep and rep[0] == a[0]:
                        gone[0] = True
                        if not rep[3]:
                            out.append(tuple(np.array([x], np.int64) for x in (rep[1], rep[2] >> 16, (rep[2] & 0xFF) + LENGTH, rep[2] >> 8 & 0xFF, rep[0])))
                    gone[1:] |= a[1:] == a[:-1]
                    gone[:-1] |= a[1:] == a[:-1]
                    rep = (a[-1], d[-1], p[-1], bool(gone[-1]))
                    out.append((d[gone], p[gone] >> 16, (p[gone] & 0xFF) + LENGTH, p[gone] >> 8 & 0xFF, a[gone]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, ("i8", "i8", "i4", "i4", "i8"), strict=True)],
                                             ["doc_id", "at", "size", "offset", "anchor"])

    return dealt.mapInArrow(scan, FOUND)


SPOTS = "doc_id long, runs array<struct<s:long,e:long>>, edges array<struct<at:long,size:int,offset:int,anchor:long>>"


def document_spots(found: DataFrame) -> DataFrame:
    """One row per document: merged removable runs, and blocks still to be compared."""
    grouped = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "size", "offset", "anchor")).alias("x"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1)
            doc = np.repeat(b.column(0).to_numpy(), np.diff(x.offsets.to_numpy()))
            at, size, offset, anchor = (np.asarray(f) for f in x.flatten().flatten())
            is_run = offset < 0
            d, s, e = merged_runs(doc[is_run], at[is_run], at[is_run] + size[is_run])
            runs: dict[int, list] = {i: [] for i in b.column(0).to_pylist()}
            edges: dict[int, list] = {i: [] for i in runs}
            for i, p, q in zip(d.tolist(), s.tolist(), e.tolist(), strict=True):
                runs[i].append({"s": p, "e": q})
            m = ~is_run
            for i, p, n, o, g in zip(doc[m].tolist(), at[m].tolist(), size[m].tolist(), offset[m].tolist(), anchor[m].tolist(), strict=True):
                edges[i].append({"at": p, "size": n, "offset": o, "anchor": g})
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(list(runs.values()), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                pa.array(list(edges.values()), pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int32()), ("offset", pa.int32()), ("anchor", pa.int64())])))],
                ["doc_id", "runs", "edges"])

    return grouped.mapInArrow(merge, SPOTS)


def maximal_repeats(group: np.ndarray, doc: np.ndarray, start: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[tuple[int, list[int], list[int]]]:
    """Maximal repeats of at least ``length`` bytes within each group of texts:
    (length, documents, starts) with all occurrences, the first one first.

    The enhanced suffix array holds the suffixes of at least ``length`` bytes;
    the stack scan closes a common-prefix interval when the prefix shared with
    the next suffix gets shorter, and keeps it if its left neighbours differ."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(256), np.uint8)
    base = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = sizes[of] - inner
    width = -(-int(sizes.max()) // 8) * 8
    rows = data[(base[of] + inner)[:, None] + np.arange(width)[None, :]]
    rows[np.arange(width)[None, :] >= left[:, None]] = 0
    words = rows.view(">u8").astype(U64)
    order = np.lexsort((start[of] + inner, doc[of], left, *words.T[::-1], group[of]))
    of, inner, left, rows = of[order], inner[order], left[order], rows[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(left[1:], left[:-1]))
    lcp = np.where(group[of[1:]] == group[of[:-1]], lcp, 0)
    before = np.where(inner > 0, data[base[of] + inner - 1].astype(np.int64), -1 - np.arange(len(of)))  # unknown is unlike any
    place = start[of] + inner
    docs, places, prev, common = doc[of].tolist(), place.tolist(), before.tolist(), lcp.tolist() + [0]
    out = []
    stack: list[list] = []  # open intervals: common prefix, first suffix, left neighbour or None if they differ
    for i, shared in enumerate(common):
        opened, seen = i, prev[i]
        while stack and stack[-1][0] > shared:
            size, opened, own = stack.pop()
            seen = own if own == seen else None  # neighbours of the whole interval, this suffix included
            if seen is None:
                at = sorted(range(opened, i + 1), key=lambda k: (docs[k], places[k]))
                out.append((size, [docs[k] for k in at], [places[k] for k in at]))
        if shared >= length:
            if stack and stack[-1][0] == shared:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else None
            else:
                stack.append([shared, opened, seen])
    return out


HALVES = "key long, doc_id long, at long, bytes binary"


def halved_blocks(spots: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``(key, doc_id, at, bytes)``: both halves of the blocks in ``edges``, ``key`` for their core."""
    held = docs.join(spots, "doc_id")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, edges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                for x in {(e["at"], e["size"], e["offset"], e["anchor"]) for e in edges}:
                    at, size, offset, anchor = x
                    last, split = size - LENGTH, offset - HALF  # windows up to ``split`` hold HALF bytes left of the anchor, the others right of it
                    for lo, hi, core in ((0, min(last, split), slice(at + split, at + split + HALF + GRAM)),
                                         (max(0, split + 1), last, slice(at + offset, at + split + 1 + LENGTH))):
                        if lo <= hi:
                            key = int.from_bytes(hashlib.blake2b(raw[core] + anchor.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                            out.append((key, i, at + lo, raw[at + lo:at + hi + LENGTH]))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             ["key", "doc_id", "at", "bytes"])

    return held.select("doc_id", "text", "edges").mapInArrow(halves, HALVES)


def crowded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Keys of more than ``most`` rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key)


def parted_halves(spots: DataFrame, docs: DataFrame, most: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Half-blocks in groups of at most ``most`` by key, and those of larger groups or None."""
    spots = spots.where(F.size("edges") > 0).select("doc_id", "edges")
    cut = halved_blocks(spots, docs)
    edges = spots.select("doc_id", F.explode("edges").alias("e")).select("doc_id", "e", "e.anchor")
    # a core belongs to one anchor, and a block has two halves
    hot = checkpointed(crowded(edges, "anchor", most // 2))
    if hot.isEmpty():
        return cut, None
    hot_spots = edges.join(hot, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("e").alias("edges"))
    hot_cut = halved_blocks(hot_spots, docs)
    large = crowded(hot_cut, "key", most)
    return cut.join(large, "key", "left_anti"), hot_cut.join(large, "key", "left_semi")


def window_repeats(cut: DataFrame) -> DataFrame:
    """Rows ``(doc_id, s, e)``: all but the first place of each 100 bytes in half-blocks of one key."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), ARRAY_ROWS):
                key, doc, at, texts = b.slice(k, ARRAY_ROWS).columns
                texts = texts.to_pylist()
                sizes = np.array([len(x) for x in texts])
                n = sizes - LENGTH + 1
                of = np.repeat(np.arange(len(n)), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = _rolling(np.frombuffer(b"".join(texts), np.uint8))[1][(np.cumsum(sizes) - sizes)[of] + inner]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    key.to_numpy()[of], window.view(np.int64), doc.to_numpy()[of], at.to_numpy()[of] + inner)], ["key", "window", "doc_id", "s"])

    w = cut.select("key", "doc_id", "at", "bytes").mapInArrow(windows, "key long, window long, doc_id long, s long")
    place = F.struct("doc_id", "s")
    first = w.groupBy("key", "window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = w.join(first.select("key", "window", "first"), ["key", "window"]).where(place > F.col("first"))
    return later.select("doc_id", "s", (F.col("s") + LENGTH).alias("e"))


def edge_repeats(spots: DataFrame, docs: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """Rows ``(doc_id, s, e)``: later occurrences of maximal repeats among blocks
    that share an anchor without being equal."""
    cut, large = parted_halves(spots, docs, most)
    cut = cut.select("key", "doc_id", "at", "bytes").repartition("key").sortWithinPartitions("key", "doc_id", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        texts: list[bytes] = []

        def repeats(upto: int) -> pa.RecordBatch:
            key, doc, at = (np.concatenate([k[j] for k in kept])[:upto] for j in range(3))
            twice = np.r_[False, key[1:] == key[:-1]]
            twice[:-1] |= twice[1:].copy()
            d, s, e = [], [], []
            if twice.any():
                own = [t for t, x in zip(texts, twice.tolist(), strict=False) if x]
                for size, docs_, places in maximal_repeats(key[twice], doc[twice], at[twice], own):
                    d += docs_[1:]
                    s += places[1:]
                    e += [p + size for p in places[1:]]
            d, s, e = merged_runs(np.array(d, np.int64), np.array(s, np.int64), np.array(e, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, s, e)], ["doc_id", "s", "e"])

        for b in batches:
            kept.append(np.stack([b.column(j).to_numpy() for j in range(3)]))
            texts += b.column(3).to_pylist()
            while len(texts) >= ARRAY_ROWS:
                key = np.concatenate([k[0] for k in kept])
                upto = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if not upto:
                    break
                yield repeats(upto)
                kept[:] = [np.concatenate(kept, axis=1)[:, upto:]]
                del texts[:upto]
        if texts:
            yield repeats(len(texts))

    found = cut.mapInArrow(scan, "doc_id long, s long, e long")
    return found if large is None else found.unionAll(window_repeats(large))


def remove_repeats(docs: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """Rows ``(doc_id, n_bytes, removed, kept)``: merged removed byte spans and the remaining bytes."""
    # a cast that changes nothing would only keep the two joins from sharing one exchange
    docs = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text")
    spots = checkpointed(document_spots(repeated_blocks(document_blocks(docs))))
    texts = docs.where("doc_id is not null").repartition("doc_id")  # dealt once, used by both joins
    edges = edge_repeats(spots, texts, most).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    none = F.array().cast("array<struct<s:long,e:long>>")
    runs = spots.select("doc_id", "runs").join(edges, "doc_id", "full").select(
        "doc_id", F.concat(F.coalesce("runs", none), F.coalesce("more", none)).alias("runs"))
    j = texts.join(runs, "doc_id", "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    j = j.unionAll(docs.where("doc_id is null").select("doc_id", "text", none.alias("runs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, kept = [], [], []
            for text, runs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                at, spans, parts = 0, [], []
                for s, e in sorted((r["s"], min(r["e"], len(raw))) for r in runs):
                    if spans and s <= spans[-1]["e"]:
                        spans[-1]["e"] = max(e, spans[-1]["e"])
                    elif s < e:
                        spans.append({"s": s, "e": e})
                for r in spans:
                    parts.append(raw[at:r["s"]])
                    at = r["e"]
                size.append(len(raw))
                removed.append(spans)
                kept.append(b"".join(parts) + raw[at:])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return j.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<s:long,e:long>>, kept binary")


def removal_digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
