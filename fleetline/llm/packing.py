"""Bounded-space online best-fit packing of tokenised documents.

Each task tokenises its documents and packs their pieces as they come: at most
``OPEN_BINS`` sequences are open, a bitset keyed by free space finds the
fullest one that still takes the piece, and when a new sequence would exceed
the bound the fullest open one is closed.  No rows move between tasks, so the
job is one narrow stage whose memory does not grow with the input.

Tokens are those of the named tokenizer file; words repeat, so each blank-led
word is encoded once per worker and looked up afterwards.  Only text whose
white space could join two words into one pre-token is encoded whole.

Defined results: a null or empty text is the end token alone; equal rows are
packed each; ``sequence_id`` is the task's number and a running number, so a
task run again gives the same rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 1024
OPEN_BINS = 1024
END_ID = 2
CACHED_WORDS = 300_000

PIECES = "doc_id long, piece int, start long, token_ids binary, sequence_id long, offset long"


class _WholeText(Exception):
    """This text cannot be encoded word by word."""


class WordTokens(dict):
    """Token ids (little-endian unsigned 32-bit) of words with a fixed lead."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _WholeText
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.encode(self.lead + word)
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class TextTokens:
    """Token ids of whole texts under a byte-level BPE given as
    ``<name>.json`` with its ranks beside it in ``<name>.tiktoken``."""

    def __init__(self, tokenizer_file: str):
        import public_tokenizers
        import tiktoken

        self.file = tokenizer_file
        with open(tokenizer_file.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.bare, self.led = WordTokens(self.encode, ""), WordTokens(self.encode, " ")
        self.line_feed = struct.pack("<I", *self.encode("\n"))
        self.full = None

    def whole(self, text: str) -> bytes:
        if "<|" in text:  # a special token's string may stand in it
            if self.full is None:
                from tokenizers import Tokenizer
                self.full = Tokenizer.from_file(self.file)
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self.whole(text)
        led, bare, parts = self.led, self.bare, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                parts.append(bare[words[0]])
                parts.extend([led[w] for w in words[1:]])
                parts.append(self.line_feed)
        except _WholeText:
            return self.whole(text)
        return b"".join(parts[:-1])


class OpenBins:
    """Open sequences by free space; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound = capacity, bound
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.bound:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        sequence = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = SEQUENCE_TOKENS,
                   open_bins: int = OPEN_BINS) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, token_ids, sequence_id, offset)``.
    A document longer than a sequence is cut so that only its first piece is
    shorter than a sequence."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins = TextTokens(tokenizer_file), OpenBins(capacity, open_bins)
        base, end = TaskContext.get().partitionId() << 40, struct.pack("<I", END_ID)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            held = 0

            def out(cols=cols):
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                  ["doc_id", "piece", "start", "token_ids", "sequence_id", "offset"])

            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokens(text.as_py()) + end
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    sequence, offset = bins.place(stop - start)
                    for c, v in zip(cols, (doc_id.as_py(), piece, start, ids[4 * start:4 * stop], base + sequence, offset), strict=True):
                        c.append(v)
                    start, stop, piece = stop, stop + capacity, piece + 1
                held += len(ids)
                if held > 8 << 20:
                    yield out()
                    held = 0
                    for c in cols:
                        c.clear()
            if cols[0]:
                yield out()

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PIECES)
    return packed.select("doc_id", "piece", "start", (F.octet_length("token_ids") / 4).cast("long").alias("length"),
                         "token_ids", "sequence_id", "offset")


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"),
                         "sequence_id", "offset")
