"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles.  For each of ``HASHES`` hash
functions the Cartesian tree over the hashes of a text (least hash on top)
gives every position c the widest stretch [l, r] in which it is the least:
all subsequences that start in [l, c] and end in [c, r] share that min-hash, so
one compact window stands for all of them.  Only windows of at least a
passage's length are kept, about 2 n / length of them.

Windows with one hash function and one least shingle meet.  A passage reaches at
least half its length to one side of the shared shingle, and an edit spoils few
neighbours, so one of three blocks beside it must agree as well: windows also
carry a short min-hash of each block, and those that share one form a group
(a frequent line alone does not).  Members are joined with the group's first
document, at each of its places, where their intervals around the shared shingle overlap by a passage,
the passages are grown from there and verified exactly.  Linked documents make components; where a group still holds several,
its members are compared across them in bounded blocks that emit only links
which join components.  Texts equal byte for byte are one class from the start.

Defined results: a null or empty text, or one shorter than a passage, has no
window; it shares a class only with equal texts of at least one word; repeated
rows are one class; rows of one doc_id are one document; a null doc_id has a
null class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, batch_rows, checkpointed, connected_components, mix64, shuffles_dropped
from .near_dup import _ODD, SHINGLE, WordHash, shingle_hashes
from .words import word_hashes

PASSAGE_WORDS = 50
SIMILARITY = 0.8
HASHES = 3
PIECE_BYTES = 2_000_000
BATCH_ROWS = 1_000
BLOCK = 512
COLUMNS = 4096
LEAD_ROWS = 16
TABLE = 4096
DENSE = 1 << 20
PAIRS = 4096

_REACH = 0xFFFF


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of x[p:p + width] at every p with room for it."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[:len(x) - rest], x[rest:]) if rest else x


def compact_windows(hashes: np.ndarray, number: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (l, c, r) of at least ``length`` in joined sequences; ``number``
    is the sequence of each position and ``ends`` where each sequence ends."""
    n = len(hashes)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none
    least = _sliding(hashes, length, np.minimum)
    fits = np.arange(len(least)) + length <= ends[number[:len(least)]]
    least = np.where(fits, least, 0).astype(hashes.dtype)
    # c is the least of some stretch if one that holds c has its hash as minimum
    padded = np.r_[np.zeros(length - 1, hashes.dtype), least, np.zeros(n - len(least), hashes.dtype)]
    at = np.flatnonzero((_sliding(padded, length, np.maximum) >= hashes) & (hashes > 0))
    if not len(at):
        return none, none, none
    # nearest smaller hashes stand among the kept positions themselves; a zero ends each sequence
    first = ends - np.bincount(number, minlength=len(ends))
    new = np.r_[True, number[at[1:]] != number[at[:-1]]]
    slot = np.arange(len(at)) + np.cumsum(new)
    h = np.zeros(len(at) + int(new.sum()) + 1, hashes.dtype)
    h[slot] = hashes[at]
    before, behind = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    before[slot] = behind[slot] = at
    before[slot[new] - 1] = first[number[at[new]]] - 1
    behind[slot[np.r_[new[1:], True]] + 1] = ends[number[at[new]]]
    l, r = before[_stops(h, slot, -1)] + 1, behind[_stops(h, slot, 1)] - 1
    wide = r - l + 1 >= length
    return l[wide], at[wide], r[wide]


def _stops(h: np.ndarray, slot: np.ndarray, step: int) -> np.ndarray:
    """The nearest place of smaller hash behind each of ``slot`` (step 1), or that
    of equal or smaller hash before it (step -1).  Places leap over what the place
    they stand on has leapt over, so that few rounds are needed."""
    to = np.arange(len(h)) + step
    left = slot
    while True:
        there = h[to[left]]
        left = left[there >= h[left] if step > 0 else there > h[left]]
        if not len(left):
            return to[slot]
        to[left] = to[to[left]]


def side_minima(shingles: np.ndarray, length: int) -> list[tuple[int, int, np.ndarray]]:
    """Of the three blocks that halve a passage in thirds: where each begins and
    ends beside a shared shingle, and the least hash of such a block at every place."""
    half = length // 2
    cuts = [1 + half * k // 3 for k in range(4)]
    salted = mix64(shingles * U64(0xD6E8FEB86659FD93))
    return [(a, b, _sliding(salted, b - a, np.minimum) if len(salted) >= b - a else np.empty(0, U64)) for a, b in zip(cuts, cuts[1:], strict=False)]


def side_marks(minima: list[tuple[int, int, np.ndarray]], c: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Six 10-bit min-hashes of the blocks beside each position c: three to the
    left, three to the right, each a third of half a passage.  A block that
    leaves the text is marked 0."""
    marks = np.zeros(len(c), np.int64)
    for k, (near, far, least) in enumerate(minima):
        for side, at in enumerate((c - far + 1, c + near)):
            inside = (at >= first) & (at + far - near <= end)
            mark = np.zeros(len(c), np.int64)
            mark[inside] = (least[at[inside]] % U64(1023)).astype(np.int64) + 1
            marks |= mark << (10 * (2 * k + side))
    return marks


def joined_shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text of each shingle, and the shingles of joined texts."""
    if not len(lengths) or lengths.min() < SHINGLE:
        return shingle_hashes(words, lengths)
    n = len(words) - SHINGLE + 1
    h = words[:n] * _ODD[0]
    for k in range(1, SHINGLE):
        h += words[k:k + n] * _ODD[k]
    whole = np.ones(n, bool)  # the last places of a text have words of the next one
    for k in range(1, SHINGLE):
        whole[np.cumsum(lengths)[:-1] - k] = False
    return np.repeat(np.arange(len(lengths)), lengths - SHINGLE + 1), mix64(h[whole])


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cuts of the texts of about ``PIECE_BYTES``, one text at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // PIECE_BYTES)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True) if len(texts) else iter(())


def each_shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """``text_shingles`` of one text after another."""
    for a, b in pieces(texts):
        number, shingles = joined_shingles(*word_hashes(texts.slice(a, b - a)))
        ends = np.cumsum(np.bincount(number, minlength=b - a)).tolist()
        yield from (shingles[x:y] for x, y in zip([0, *ends], ends, strict=False))


def passage_windows(docs: DataFrame, words: int = PASSAGE_WORDS, hashes: int = HASHES) -> DataFrame:
    """Rows ``(key, doc_id, place, marks)`` of all compact windows: ``key`` is hash
    function and least shingle, ``place`` packs c, c - l and r - c."""
    length = words - SHINGLE + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for low, high in pieces(b.column(1)):
                spelt, per = word_hashes(b.column(1).slice(low, high - low))
                enough = per >= words
                if not enough.any():
                    continue
                doc, per, spelt = ids[low:high][enough], per[enough], spelt[np.repeat(enough, per)]
                number, shingles = joined_shingles(spelt, per)
                ends = np.cumsum(per - SHINGLE + 1)
                starts = ends - (per - SHINGLE + 1)
                minima = side_minima(shingles, length)
                for i in range(hashes):
                    salted = mix64(shingles ^ mix64(np.array([i + 1], U64)))
                    l, c, r = compact_windows((salted >> U64(32)).astype(np.uint32), number, ends, length)
                    of = number[c]
                    place = ((c - starts[of]) << 32) | (np.minimum(c - l, _REACH) << 16) | np.minimum(r - c, _REACH)
                    marks = side_marks(minima, c, starts[of], ends[of])
                    yield pa.RecordBatch.from_arrays([pa.array(salted[c].view(np.int64)), pa.array(doc[of]), pa.array(place), pa.array(marks)],
                                                     ["key", "doc_id", "place", "marks"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(windows, "key long, doc_id long, place long, marks long")


def text_shingles(text: str | None, cache: WordHash) -> np.ndarray:
    w = (text or "").split()
    h = np.fromiter(map(cache.__getitem__, w), U64, len(w))
    if len(w) < SHINGLE:
        return shingle_hashes(h, np.array([len(w)]))[1] if w else np.empty(0, U64)
    n = len(w) - SHINGLE + 1
    return mix64(sum(h[k:k + n] * _ODD[k] for k in range(SHINGLE)))


def _longest(same: np.ndarray, left: int, share: float) -> tuple[int, int]:
    """The longest stretch over position ``left`` in which ``share`` of the positions are set."""
    score = np.zeros(len(same) + 1)
    np.cumsum(np.where(same, 1 - share, -share), out=score[1:])
    tail = np.maximum.accumulate(score[left + 1:][::-1])[::-1]  # greatest score at or behind each end
    lower = np.ones(left + 1, bool)
    np.less(score[1:left + 1], np.minimum.accumulate(score[:left]), out=lower[1:])
    starts = np.flatnonzero(lower)
    # tail falls from left to right: the last end that reaches each start's score
    ends = len(tail) - np.searchsorted(tail[::-1], score[starts] - 1e-9)
    size = np.where(ends > 0, left + ends - starts, 0)
    best = int(np.argmax(size))
    return (int(starts[best]), int(starts[best] + size[best])) if size[best] > 0 else (0, 0)


def _found(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` stand in the sorted ``ordered``."""
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def _held(same: np.ndarray, length: int, share: float) -> np.ndarray | None:
    """Positions that some stretch of ``length`` or more holds in which ``share``
    of the positions are set; None if there is none."""
    if np.count_nonzero(same) < share * length - 1e-6:
        return None
    score = np.zeros(len(same) + 1)
    np.cumsum(np.where(same, 1 - share, -share), out=score[1:])
    least = np.minimum.accumulate(score)
    end = np.flatnonzero(least[:-length] <= score[length:] + 1e-6) + length
    if not len(end):
        return None
    start = np.searchsorted(-least, -score[end] - 1e-6)  # the first start that reaches the score of each end
    n = len(score)
    return np.cumsum(np.bincount(start, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0


def met_in(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``a`` stand in ``b``, the order of ``b``, and where in it each of ``a`` would stand."""
    order = np.argsort(b)
    ordered = b[order]
    at = np.searchsorted(ordered, a)
    at[at == len(b)] = 0
    return ordered[at] == a, order, at


def numbered(a: np.ndarray, b: np.ndarray, in_b: np.ndarray, order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sequences with the shingles they share as 0, 1, ... and the others
    as -1 in ``a`` and -2 in ``b``, and how many are shared; ``met_in`` gives the rest."""
    shared = np.zeros(len(b), bool)  # by place in the order, set at the first of equal ones
    shared[at[in_b]] = True
    number = np.cumsum(shared) - 1
    x, y = np.full(len(a), -1), np.empty(len(b), np.int64)
    x[in_b] = number[at[in_b]]
    ordered = b[order]
    first = np.zeros(len(b), np.int64)
    np.copyto(first[1:], np.arange(1, len(b)), where=ordered[1:] != ordered[:-1])
    first = np.maximum.accumulate(first)
    y[order] = np.where(shared[first], number[first], -2)
    return x, y, int(number[-1]) + 1


def _among(x: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """Which of the numbered ``x`` stand in the numbered ``y``."""
    there = np.zeros(kinds + 2, bool)  # the last two are for -1 and -2
    there[y] = True
    there[kinds:] = False
    return there[x]


def reachable(a: np.ndarray, b: np.ndarray, ordered_a: np.ndarray, ordered_b: np.ndarray, length: int,
              similarity: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of ``a`` and of ``b`` outside which no anchor can grow into a
    passage, whatever its other end: a stretch of ``a`` over it has
    ``grown_passage``'s share of shingles that ``b`` has too, and the stretch of
    ``b`` beside it has ``similarity`` of its shingles in ``a`` (a Jaccard
    similarity bounds either side's common part).  None if there are none."""
    if not len(a) or not len(b):
        return None
    of_a = _held(_found(a, ordered_b), length, 2 * similarity / (1 + similarity))
    if of_a is None:
        return None
    of_b = _held(_found(b, ordered_a), length, similarity)
    return None if of_b is None else (of_a, of_b)


def least_passage(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, length: int, similarity: float) -> tuple[int, int, int, int] | None:
    """The most similar stretches of exactly ``length`` over a shared shingle, if
    they are similar enough: all pairs of such stretches are counted."""
    s, t = max(0, at_a - length + 1), max(0, at_b - length + 1)
    xs, ys = a[s:at_a + length], b[t:at_b + length]
    if min(len(xs), len(ys)) < length:
        return None
    shared = np.intersect1d(xs, ys)
    per = []
    for z in (xs, ys):
        upto = np.cumsum(np.c_[np.zeros(len(shared), bool), z[None, :] == shared[:, None]], axis=1, dtype=np.int16)
        per.append(upto[:, length:] - upto[:, :-length])  # by shared shingle and start
    both = np.minimum(per[0][:, :, None], per[1][:, None, :]).sum(axis=0)
    i, j = np.unravel_index(int(both.argmax()), both.shape)
    if both[i, j] < similarity * (2 * length - both[i, j]) - 1e-9:
        return None
    return s + int(i), s + int(i) + length, t + int(j), t + int(j) + length


def reachable_pair(a: np.ndarray, b: np.ndarray, length: int, similarity: float) -> tuple | None:
    """``reachable`` and ``numbered`` of a pair: None, or (positions of a, positions of b, a, b, kinds)."""
    if not len(a) or not len(b):
        return None
    in_b, order, at = met_in(a, b)
    of_a = _held(in_b, length, 2 * similarity / (1 + similarity))
    if of_a is None:
        return None
    x, y, kinds = numbered(a, b, in_b, order, at)
    of_b = _held(y >= 0, length, similarity)
    return None if of_b is None else (of_a, of_b, x, y, kinds)


def grown_passage(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, length: int, similarity: float,
                  seen: dict | None = None) -> tuple[int, int, int, int] | None:
    """``grown`` of sequences of shingles."""
    x, y, kinds = numbered(a, b, *met_in(a, b))
    return grown(x, y, kinds, at_a, at_b, length, similarity, seen)


def grown(a: np.ndarray, b: np.ndarray, kinds: int, at_a: int, at_b: int, length: int, similarity: float,
          seen: dict | None = None) -> tuple[int, int, int, int] | None:
    """The longest stretch of ``a`` around a shingle shared with ``b`` (aligned
    there) that is similar enough to a stretch of ``b``: shingle spans (a from,
    to, b from, to), or None if no stretch is long enough.  Both sides hold
    ``length`` shingles at least, unshared ones at their edges included.  Both
    are ``numbered``, with ``kinds`` different shared shingles.
    ``seen`` keeps what anchors of one pair with the same distance share."""
    share = 2 * similarity / (1 + similarity)  # common part of equal-length stretches at this Jaccard similarity
    left, right = min(at_a, at_b), min(len(a) - at_a, len(b) - at_b)
    xs, ys = a[at_a - left:at_a + right], b[at_b - left:at_b + right]
    seen = {} if seen is None else seen
    if at_a - at_b not in seen:
        aligned = xs == ys
        # where one text ends the other may go on by a passage
        first = max(0, at_a - left - length)
        met = _among(a[first:at_a + right + length], b[max(0, at_b - left - length):at_b + right + length], kinds)
        upto = np.zeros(len(met) + 1, np.int64)
        np.cumsum(met, out=upto[1:])
        seen[at_a - at_b] = aligned, aligned | _among(xs, ys, kinds), first, upto
    aligned, anywhere, first, met = seen[at_a - at_b]
    if met[-1] < share * length - 1e-9:  # too little in common at this distance for any passage
        return None
    # shingles met anywhere allow for inserted and lost words; strictly aligned ones for texts that repeat themselves
    for same in (anywhere, aligned):
        s, e = _longest(same, left, share)
        if e - s < length:
            continue
        x = xs[s:e]
        hit = np.flatnonzero(_among(ys, x, kinds) if same is not aligned else aligned)
        hit = hit[(hit >= s - length // 4) & (hit < e + length // 4)]
        y0, y1 = at_b - left + int(hit[0]), at_b - left + int(hit[-1]) + 1
        if y1 - y0 < length:  # unshared edges count as they do in x
            y0 = max(0, y1 - length, min(y0, len(b) - length, at_b - left + s))
            y1 = y0 + length
        y = b[y0:y1]
        both = np.minimum(np.bincount(x[x >= 0], minlength=kinds), np.bincount(y[y >= 0], minlength=kinds)).sum()
        if both >= similarity * (len(x) + len(y) - both) - 1e-9 and len(y) >= length:
            return at_a - left + s, at_a - left + e, y0, y1
    near = met[min(at_a + length - first, len(met) - 1)] - met[max(0, at_a - length + 1 - first)]
    return least_passage(a, b, at_a, at_b, length, similarity) if near >= share * length - 1e-9 else None


LINKS = "a long, b long, a_from int, a_to int, b_from int, b_to int"


def link_batch(links: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*links, strict=True)) if links else [()] * 6
    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "a_from", "a_to", "b_from", "b_to"])


def shingle_bits(shingles: np.ndarray) -> bytes:
    """A table of four bits or more per shingle with a bit set for each."""
    size = 8
    while size < 4 * len(shingles):
        size *= 2
    table = np.zeros(size, bool)
    table[(shingles & U64(size - 1)).astype(np.int64)] = True
    return np.packbits(table).tobytes()


def in_bits(shingles: np.ndarray, bits: bytes) -> np.ndarray:
    """Which shingles have their bit set: all of the table's own and a few more."""
    table = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
    return table[(shingles & U64(len(table) - 1)).astype(np.int64)]


def shipped_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs as ``(stay, go, a_stays, anchors)``: the shorter text goes to the longer."""
    size = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))  # a document may have several rows
    both = pairs.join(size.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b")), "b").join(
        size.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a")), "a")
    a_stays = F.col("n_a") >= F.col("n_b")
    return both.select(F.when(a_stays, F.col("a")).otherwise(F.col("b")).alias("stay"), F.when(a_stays, F.col("b")).otherwise(F.col("a")).alias("go"),
                       a_stays.alias("a_stays"), "anchors")


ANCHORS = "array<struct<x:int,y:int>>"


def as_anchors(packed: Column) -> Column:
    """The anchors in an array of longs, x above y.  Different longs are found by
    hashing, different structs would be by comparing all with all."""
    return F.transform(packed, lambda p: F.struct(F.shiftright(p, 32).cast("int").alias("x"), p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("y")))


def anchors_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, tuple[np.ndarray, np.ndarray]]:
    """Of a column of ``ANCHORS`` where each row's begin, the anchors of all rows, and their x and y."""
    at = column.flatten()
    start = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]
    x, y = (f.to_numpy(zero_copy_only=False) for f in at.flatten())
    return start, at, (x, y)


def texts_by_key(keys: pa.Array, texts: pa.Array, held: int | None) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Which rows have another key than the row before (the first: than ``held``),
    and the shingles of those rows' texts."""
    k = keys.to_numpy()
    new = np.r_[k[:1] != held, k[1:] != k[:-1]].astype(bool)
    return new, each_shingles(texts.take(pa.array(np.flatnonzero(new))))


def pairs_in_reach(shipped: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs and anchors that ``reachable`` may leave: the longer text is held
    against the ``shingle_bits`` of the shorter, which set too many positions
    but miss none, so that no passage is lost and few texts travel."""
    length = words - SHINGLE + 1

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(shingle_bits, each_shingles(b.column(1))), pa.binary())], ["go", "bits"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, np.empty(0, U64)
        for batch in batches:
            new, texts_held = texts_by_key(batch.column(0), batch.column(5), held)
            start, at, sides = anchors_of(batch.column(3))
            kept = np.zeros(len(at), bool)
            for k, (a_stays, table) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if new[k]:
                    long = next(texts_held)
                if not len(long):
                    continue
                may = _held(in_bits(long, table), length, 2 * similarity / (1 + similarity) if a_stays else similarity)
                if may is not None:
                    own = slice(start[k], start[k + 1])
                    place = sides[0 if a_stays else 1][own]
                    kept[own] = (place < len(long)) & may[np.minimum(place, len(long) - 1)]
            held = batch.column(0)[-1].as_py() if len(new) else held
            left = np.diff(np.r_[0, np.cumsum(kept)][start])
            rows = pa.array(np.flatnonzero(left))
            anchors = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left[left > 0])], pa.int32()), at.filter(pa.array(kept)),
                                               type=batch.schema.field(3).type)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), anchors], ["stay", "go", "a_stays", "anchors"])

    tables = texts.select("doc_id", "text").join(shipped.select(F.col("go").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(
        bits, "go long, bits binary")
    both = shipped.join(tables, "go").join(texts.select(F.col("doc_id").alias("stay"), "text"), "stay")
    left = both.select("stay", "go", "a_stays", "anchors", "bits", "text").mapInArrow(reach, f"stay long, go long, a_stays boolean, anchors {ANCHORS}")
    # of documents with several rows each two rows are held against each other
    packed = F.transform("anchors", lambda p: F.shiftleft(p["x"].cast("long"), 32).bitwiseOR(p["y"].cast("long")))
    return left.groupBy("stay", "go", "a_stays").agg(as_anchors(F.array_distinct(F.flatten(F.collect_list(packed)))).alias("anchors"))


def verified_links(shipped: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Passages (word spans) that the anchors of each pair grow into."""
    length = words - SHINGLE + 1
    both = shipped.join(texts.select(F.col("doc_id").alias("go"), F.col("text").alias("text_go")), "go")
    both = both.join(texts.select(F.col("doc_id").alias("stay"), F.col("text").alias("text_stay")), "stay")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, np.empty(0, U64)
        for batch in batches:
            out = []
            new, texts_held = texts_by_key(batch.column(0), batch.column(4), held)
            start, _, (xs, ys) = anchors_of(batch.column(3))
            for k, (stay, go, a_stays, short) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), each_shingles(batch.column(5)), strict=True)):
                if new[k]:
                    held, long = stay, next(texts_held)
                a, b, sa, sb = (stay, go, long, short) if a_stays else (go, stay, short, long)
                may = reachable_pair(sa, sb, length, similarity)
                if may is None:
                    continue
                of_a, of_b, na, nb, kinds = may
                done: list[tuple] = []
                seen: dict = {}
                x, y = xs[start[k]:start[k + 1]], ys[start[k]:start[k + 1]]
                left = np.flatnonzero((x < len(sa)) & (y < len(sb)) & of_a[np.minimum(x, len(sa) - 1)] & of_b[np.minimum(y, len(sb) - 1)])
                for p in sorted(zip(x[left].tolist(), y[left].tolist(), strict=True)):
                    if not any(d[0] <= p[0] < d[1] and d[2] <= p[1] < d[3] for d in done):
                        got = grown(na, nb, kinds, *p, length, similarity, seen)
                        if got:
                            done.append(got)
                out += [(a, b, d[0], d[1] + SHINGLE - 1, d[2], d[3] + SHINGLE - 1) for d in done]
            yield link_batch(out)

    return both.select("stay", "go", "a_stays", "anchors", "text_stay", "text_go").mapInArrow(verify, LINKS)


def common_shingles(near: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """How many shingles each of the stretches ``rows`` (or all) has in common
    with each stretch, repeated ones counted: a product of indicator matrices."""
    rows = np.arange(len(near)) if rows is None else rows
    shingles = np.concatenate(near)
    number = np.repeat(np.arange(len(near)), [len(x) for x in near])
    both = np.zeros((len(rows), len(near)), np.float32)
    if not sum(len(near[k]) for k in rows):
        return both
    if len(rows) < len(near):  # shingles that stand in none of the rows do not count
        asked = _found(shingles, np.sort(np.concatenate([near[k] for k in rows])))
        shingles, number = shingles[asked], number[asked]
    order = np.argsort(shingles, kind="stable")  # by number within
    shingles, number = shingles[order], number[order]
    new = np.r_[True, shingles[1:] != shingles[:-1]]
    first = np.flatnonzero(new | np.r_[True, number[1:] != number[:-1]])
    nth = np.arange(len(number)) - np.repeat(first, np.diff(np.r_[first, len(number)]))  # of equal shingles of a stretch
    column, most = np.cumsum(new) - 1, int(nth.max())
    if most:
        column = np.unique(column * (most + 1) + nth, return_inverse=True)[1]
    held = np.bincount(column)
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]
    number, column = number[column >= 0], column[column >= 0]
    times = np.ones(int(column.max(initial=-1)) + 1, np.float32)
    if len(rows) * len(near) * len(times) > DENSE:
        number, column, times = merged_columns(number, column, len(times))
    for low in range(0, len(times), COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        held_by = np.zeros((len(near), min(COLUMNS, len(times) - low)), np.float32)
        held_by[number[here], column[here] - low] = 1
        both += (held_by[rows] * times[low:low + COLUMNS]) @ held_by.T
    return both


def merged_columns(number: np.ndarray, column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of an indicator matrix with equal columns as one, and how many
    each stands for: a passage that some stretches share makes as many equal
    columns as it has shingles.  Columns are equal if 64-bit sums of their cells are."""
    order = np.argsort(column, kind="stable")
    number, column = number[order], column[order]
    cells = np.add.reduceat(mix64((number + 1).astype(U64)), np.searchsorted(column, np.arange(columns)))
    _, one, times = np.unique(cells, return_index=True, return_counts=True)
    place = np.full(columns, -1)
    place[one] = np.arange(len(one))
    column = place[column]
    return number[column >= 0], column[column >= 0], times.astype(np.float32)


def may_reach(near: list[np.ndarray], i: np.ndarray, j: np.ndarray, length: int, share: float) -> np.ndarray:
    """Which pairs of stretches (i, j) ``reachable_pair`` may leave: ``_held`` of
    all pairs at once, with a bit table per stretch, so that some more are left
    but none is missed."""
    if not len(i):
        return np.zeros(0, bool)
    sizes = np.array([len(x) for x in near])
    bits = (np.concatenate(near) & U64(TABLE - 1)).astype(np.int64)
    table = np.zeros((len(near), TABLE), bool)
    table[np.repeat(np.arange(len(near)), sizes), bits] = True
    first = np.cumsum(sizes) - sizes
    found = []
    for low in range(0, len(i), PAIRS):
        a, b = i[low:low + PAIRS], j[low:low + PAIRS]
        size = sizes[a]
        begin = np.cumsum(size + 1) - size - 1  # of each pair's scores, one more than it has shingles
        step = np.full(int(size.sum()) + len(a), -share)
        place = np.ones(len(step), bool)
        place[begin] = False
        met = table[np.repeat(b, size), bits[np.arange(int(size.sum())) + np.repeat(first[a] - np.cumsum(size) + size, size)]]
        step[place] += met
        step[begin] = -1 - sizes.max()  # below all scores before, so that none is a start for this pair
        score = np.cumsum(step)
        held = np.zeros(len(score) + 1, np.int64)
        if len(score) > length:
            np.cumsum(np.minimum.accumulate(score)[:-length] <= score[length:] + 1e-6, out=held[length + 1:])
        # ends of stretches that begin within the pair
        found.append(held[begin + size + 1] > held[np.minimum(begin + length, begin + size + 1)])
    return np.concatenate(found)


def block_links(ids: list[int], classes: list[int], sides: list[int], stretch: list, centre: list[int], off: list[int], length: int,
                similarity: float, cache: WordHash | None = None) -> list[tuple]:
    """Links that join different classes among the stretches of one block, in
    order of document and place: of each the shingles around a shared one (or
    the words, with a cache of their hashes), its place in them, and the place of
    the first.  Stretches of side 0 meet all others, those of sides 1 and 2 only
    the other side."""
    named, side = np.array(classes), np.array(sides)
    if (named == named[0]).all():
        return []
    # every pair to compare has one of these: those outside the largest class, or the smaller side
    values, counts = np.unique(named, return_counts=True)
    asked = np.flatnonzero(named != values[counts.argmax()])
    if (side > 0).all():
        asked = min(np.flatnonzero(side == 1), np.flatnonzero(side == 2), asked, key=len)
    if not len(asked):
        return []
    near = stretch if cache is None else [text_shingles(t, cache) for t in stretch]
    root, out = {c: c for c in classes}, []

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    enough = 2 * similarity / (1 + similarity) * length - 1e-9  # what two such passages have in common at least
    alike = np.zeros((len(near), len(near)), bool)
    alike[asked] = (common_shingles(near, asked) >= enough) & (named[asked, None] != named) & ((side[asked, None] == 0) | (side[asked, None] != side))
    alike |= alike.T
    left, right = np.triu(alike, 1).nonzero()
    some = may_reach(near, left, right, length, 2 * similarity / (1 + similarity))
    for i, j in zip(left[some].tolist(), right[some].tolist(), strict=True):
        a, b = top(classes[i]), top(classes[j])
        if a == b:
            continue
        may = reachable_pair(near[i], near[j], length, similarity)
        if may is None or not may[0][centre[i]] or not may[1][centre[j]]:
            continue
        got = grown(*may[2:], centre[i], centre[j], length, similarity)
        if got:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j], off[i] + got[0], off[i] + got[1] + SHINGLE - 1, off[j] + got[2], off[j] + got[3] + SHINGLE - 1))
    return out


def linked_blocks(rows: DataFrame, length: int, similarity: float) -> DataFrame:
    """``block_links`` of each block: rows are dealt by block and sorted, so that
    a task has the rows of one block after another."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, links = None, [], []

        def compared() -> list[tuple]:
            _, ids, off, centre, classes, sides, stretch = zip(*block, strict=True)
            return block_links(ids, classes, sides, stretch, centre, off, length, similarity)

        for b in batches:
            of = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            for key, *rest in zip(of, *(b.column(k).to_pylist() for k in range(3, 8)), each_shingles(b.column(8)), strict=True):
                if key != held:
                    links += compared() if block else []
                    held, block = key, []
                row = (key, *rest)
                if not block or row[:4] != block[-1][:4]:  # a place once
                    block.append(row)
            yield link_batch(links)
            links = []
        if block:
            yield link_batch(compared())

    order = ["key", "p", "q", "doc_id", "off", "at"]
    dealt = rows.select(*order, "class_id", "side", "stretch").repartition("key", "p", "q").sortWithinPartitions(*order)
    return dealt.mapInArrow(compare, LINKS)


def stretches(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The words that a passage around each shared shingle can reach, instead of the text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, words = None, []
            out, at, off = [], [], []
            for doc, place, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(7), strict=True):
                if doc != held:
                    held, words = doc, (text.as_py() or "").split()
                c = place >> 32
                first = max(0, c - 2 * length, c - (place >> 16 & _REACH))
                out.append(" ".join(words[first:min(c + 2 * length, c + (place & _REACH)) + SHINGLE]))
                at.append(c - first)
                off.append(first)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(5), b.column(6), pa.array(out, pa.string()), pa.array(at, pa.int32()), pa.array(off, pa.int32())],
                                             ["key", "p", "q", "doc_id", "class_id", "side", "stretch", "at", "off"])

    held = rows.join(texts, "doc_id").select("key", "p", "q", "doc_id", "place", "class_id", "side", "text")
    return held.mapInArrow(cut, "key long, p int, q int, doc_id long, class_id long, side int, stretch string, at int, off int")


def dealt_members(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members ``(key, p, q, doc_id, place, class_id, side)`` of the groups whose
    members other than the first document are of several classes.  A group of at
    most ``block`` members is one block.  In a larger one those outside its
    largest class meet, by blocks, each other and that class; the members of
    the largest class, which are linked already, do not meet each other."""
    per = placed.groupBy("key", "class_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("doc_id") > F.col("lead"), 1)).alias("others"))
    other = F.when(F.col("others") > 0, F.col("class_id"))
    mixed = per.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class_id")).alias("largest"), F.min(other).alias("x"),
                                   F.max(other).alias("y")).where("x < y")
    small = F.col("n") <= block
    blocks = lambda n: F.ceil(n / block).cast("int")
    mixed = mixed.select("key", small.alias("small"), F.col("largest.class_id").alias("largest"), blocks(F.col("largest.n")).alias("within"),
                         blocks(F.col("n") - F.col("largest.n")).alias("outside"))
    rows = placed.join(mixed, "key").withColumn("inside", F.col("class_id") == F.col("largest")).withColumn(
        "own", F.pmod(F.xxhash64("doc_id", "place"), F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))).cast("int"))
    cell = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    none, own = F.lit(0), F.col("own")
    meets_outside = F.transform(upto(F.col("outside")), lambda o: cell(-1 - F.least(own, o), F.greatest(own, o), F.when(own == o, 0).when(own < o, 1).otherwise(2)))
    meets_within = F.transform(upto(F.col("within")), lambda p: cell(p, own, F.lit(1)))
    cells = F.when(F.col("small"), F.array(cell(none, none, none))).when(
        F.col("inside"), F.transform(upto(F.col("outside")), lambda q: cell(own, q, F.lit(2)))).otherwise(F.concat(meets_within, meets_outside))
    return rows.select("key", F.explode(cells).alias("cell"), "doc_id", "place", "class_id").select(
        "key", "cell.p", "cell.q", "doc_id", "place", "class_id", "cell.side")


def links_in_mixed_groups(shared: DataFrame, classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Passage links between members of one group that are in different components."""
    length = words - SHINGLE + 1
    placed = shared.join(classes.select(F.col("id").alias("doc_id"), "class_id"), "doc_id", "left").withColumn(
        "class_id", F.coalesce("class_id", "doc_id"))
    return linked_blocks(stretches(dealt_members(placed), texts, length), length, similarity)


def near_duplicate_passages(docs: DataFrame, words: int = PASSAGE_WORDS, similarity: float = SIMILARITY,
                            hashes: int = HASHES) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: rows ``(doc_id, class_id)`` of every document, the
    class named by its least doc_id, and the verified passages between
    different texts as word spans ``(a, b, a_from, a_to, b_from, b_to)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with shuffles_dropped(docs.sparkSession), batch_rows(docs.sparkSession, BATCH_ROWS):  # the windows of texts that meet no other are most of the disk
        content = F.unhex(F.md5(F.col("text").cast("binary")))
        # texts are read once for both sides of the join
        equal = checkpointed(docs.where("doc_id is not null").where(F.ltrim("text", F.lit(" \t\n\x0b\f\r")) != "").select("doc_id", content.alias("content")))
        rep_of = checkpointed(equal.join(equal.groupBy("content").agg(F.min("doc_id").alias("rep")), "content").select("doc_id", "rep").distinct())
        reach = lambda p, by: F.shiftright(p, by).bitwiseAND(F.lit(_REACH))
        # dealt once by key: a window over the key tells whether another document meets there
        windows = passage_windows(docs, words, hashes)
        same = Window.partitionBy("key")
        met = windows.select("*", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi")).where("lo < hi").drop("lo", "hi")
        # of equal texts one takes part
        met = met.join(rep_of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
        # places of one text that look alike on both sides (a text that repeats itself): the one with most room
        met = met.groupBy("doc_id", "key", "marks").agg(F.max_by("place", F.struct(reach("place", 16) + reach("place", 0), -F.col("place"))).alias("place"))
        met = checkpointed(met)
        mark = [F.shiftright("marks", 10 * k).bitwiseAND(F.lit(1023)) for k in range(6)]
        met = met.select("doc_id", "place", F.explode(F.array(*[
            F.when(m > 0, F.xxhash64("key", F.lit(k), m)) for k, m in enumerate(mark)])).alias("key")).where("key is not null").repartition("key")
        groups = met.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"),
                                        F.bit_xor(F.xxhash64("doc_id", "place")).alias("members")).where("lead < last")
        # of groups with the same places (the blocks of one exact repeat) one is enough
        groups = groups.groupBy("lead", "last", "members").agg(F.min("key").alias("key"))
        shared = checkpointed(met.join(groups.select("key", "lead"), "key"))
        # all places of a first document that repeats itself, in bounded rows
        leads = shared.where("doc_id = lead").groupBy("key", F.pmod(F.xxhash64("place"), F.lit(LEAD_ROWS)).alias("part")).agg(
            F.collect_set("place").alias("lead_places")).select("key", "lead_places")
        overlap = lambda x: F.least(reach("place", 16), reach(x, 16)) + F.least(reach("place", 0), reach(x, 0)) + 1
        near = shared.where("doc_id > lead").join(leads, "key").select("lead", "doc_id", "place", F.explode("lead_places").alias("x")).where(
            overlap("x") >= (words - SHINGLE + 1) * similarity)
        packed = F.col("x").bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.shiftright("place", 32))
        pairs = near.groupBy(F.col("lead").alias("a"), F.col("doc_id").alias("b")).agg(as_anchors(F.collect_set(packed)).alias("anchors"))
        pairs = checkpointed(pairs)
        several = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key")
        asked = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).unionAll(
            shared.join(several, "key", "left_semi").select("doc_id")).distinct()
        texts = checkpointed(docs.join(asked, "doc_id"))
        pairs = checkpointed(pairs_in_reach(shipped_pairs(pairs, texts), texts, words, similarity))
        links = checkpointed(verified_links(pairs, texts, words, similarity))
        classes = connected_components(links.select("a", "b"))
        more = checkpointed(links_in_mixed_groups(shared, classes, texts, words, similarity))
        if not more.isEmpty():
            links = links.unionAll(more)
            classes = connected_components(links.select("a", "b"))
    named = rep_of.join(classes.select(F.col("id").alias("rep"), "class_id"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("class_id", "rep")).alias("class_id"))
    result = docs.select("doc_id").join(named, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return result, links


def passage_digests(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Per document its class and how many verified passages link it to other texts."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), (F.col("a_to") - F.col("a_from")).alias("n")),
                                          F.struct(F.col("b").alias("doc_id"), (F.col("b_to") - F.col("b_from")).alias("n")))).alias("e"))
    counts = ends.groupBy("e.doc_id").agg(F.count("*").alias("n_links"), F.max("e.n").cast("long").alias("longest_words"))
    return classes.join(counts, "doc_id", "left").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("longest_words", F.lit(0)).alias("longest_words"))
