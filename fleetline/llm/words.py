"""Hashes of the words of many texts at once, straight from Arrow's buffers.

Words are those of ``str.split`` and a word's hash is the 64-bit XXH3 of its
UTF-8 bytes, the same numbers as ``near_dup.WordHash`` gives.  A dictionary of
words costs half a microsecond a word, as a large corpus has many rare ones;
here words of up to 16 bytes, nearly all, are hashed by whole-array steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import U64

_BLANKS = [chr(c).encode() for c in range(0x3001) if chr(c).isspace()]
_BLANK, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[c[0] for c in _BLANKS if len(c) == 1]] = True
_LEAD[[c[0] for c in _BLANKS if len(c) > 1]] = True  # first bytes of the other blanks
_LONGER = {size: np.array([int.from_bytes(c, "big") for c in _BLANKS if len(c) == size]) for size in (2, 3)}

# what XXH3 takes from its secret for words of 1 to 3, 4 to 8 and 9 to 16 bytes without a seed
_FLIP_3, _FLIP_8 = U64(0x87275A9B), U64(0xC73AB174C5ECD5A2)
_FLIP_LOW, _FLIP_HIGH = U64(0x6782737BEA4239B9), U64(0xAF56BC3B0996523A)
_HALF = U64(0xFFFFFFFF)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    x ^= x >> U64(by)
    return x


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _folded_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The low half of the 128-bit product, with the high half folded in."""
    x0, x1, y0, y1 = x & _HALF, x >> U64(32), y & _HALF, y >> U64(32)
    cross = x1 * y0 + ((x0 * y0) >> U64(32))
    other = x0 * y1 + (cross & _HALF)
    return (x1 * y1 + (cross >> U64(32)) + (other >> U64(32))) ^ (x * y)


def _loaded(data: np.ndarray, kind: str, at: np.ndarray) -> np.ndarray:
    """Little-endian numbers at any byte positions."""
    return np.ndarray(len(data) - np.dtype(kind).itemsize + 1, kind, data, 0, (1,))[at].astype(U64, copy=False)


def _upto_3(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    low, mid, last = (data[i].astype(U64) for i in (at, at + (size >> 1), at + size - 1))
    h = ((low << U64(16)) | (mid << U64(24)) | last | (size.astype(U64) << U64(8))) ^ _FLIP_3
    h = _shifted(h, 33) * U64(0xC2B2AE3D27D4EB4F)
    h = _shifted(h, 29) * U64(0x165667B19E3779F9)
    return _shifted(h, 32)


def _upto_8(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = (_loaded(data, "<u4", at + size - 4) + (_loaded(data, "<u4", at) << U64(32))) ^ _FLIP_8
    h ^= _turned(h, 49) ^ _turned(h, 24)
    h *= U64(0x9FB21C651E98DF25)
    h ^= (h >> U64(35)) + size.astype(U64)
    h *= U64(0x9FB21C651E98DF25)
    return _shifted(h, 28)


def _upto_16(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    low, high = _loaded(data, "<u8", at) ^ _FLIP_LOW, _loaded(data, "<u8", at + size - 8) ^ _FLIP_HIGH
    h = size.astype(U64) + low.byteswap() + high + _folded_product(low, high)
    h = _shifted(h, 37) * U64(0x165667919E3779F9)
    return _shifted(h, 32)


def _blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are of blanks."""
    blank = _BLANK.take(data)
    if len(data) and data.max() >= 0xC2:
        lead = np.flatnonzero(_LEAD.take(data))
        code = data[lead].astype(np.int64)
        for size, codes in _LONGER.items():
            code = code << 8 | data[np.minimum(lead + size - 1, len(data) - 1)]
            at = lead[np.isin(code, codes)]
            for k in range(size):
                blank[at + k] = True
    return blank


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, one text after another, and how many
    words each has; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    edge = np.ones(len(data) + 1, bool)  # before which bytes a word cannot go on
    blank = _blank(data)
    edge[1:-1] = blank[:-1]
    edge[ends] = True
    at = np.flatnonzero(edge[:-1] & ~blank)
    edge[:-1] |= blank
    size = np.flatnonzero(edge[1:] & ~blank) + 1 - at
    lengths = np.diff(np.searchsorted(at, ends))
    hashes = np.empty(len(at), U64)
    for above, upto, hashed in ((0, 3, _upto_3), (3, 8, _upto_8), (8, 16, _upto_16)):
        some = np.flatnonzero((size > above) & (size <= upto))
        if len(some):
            hashes[some] = hashed(data, at[some], size[some])
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = data.tobytes()
        hashes[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at[long].tolist(), (at + size)[long].tolist(), strict=True)]
    return hashes, lengths
