"""Words and hashes of whole text columns, as numpy over Arrow buffers.

A word is a run of bytes other than space and \\x09-\\x0D; UTF-8 never uses
those byte values inside a longer character, so splitting bytes splits
characters. Every hash is a polynomial over Z/2^64 taken from prefix sums,
then mixed; callers that need more certainty than 64 bits combine two.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE_BYTES = 0x9E3779B97F4A7C15
BASE_WORDS = 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (returns a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2^64 for i < n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _powers[base] = (made[0], made[1])
        if size > 8 * CHUNK_BYTES:       # tables of a huge text are not kept
            del _powers[base]
    return have[0][:n], have[1][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for every (s, e): equal ranges get equal hashes."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    return mix64(h)


class Words(NamedTuple):
    """Words of a block of documents: byte ranges, and the index of each
    document's first word (one more entry than documents)."""
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        return range_hashes(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, BASE_BYTES)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def scan_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, offsets, empty, empty, np.zeros(len(offsets), np.int64))
    space = _IS_SPACE[data]
    inside = ~space
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]      # words never span two documents
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return Words(data, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of a batch holding about ``limit`` bytes of text each (a longer
    single text makes a slice of its own), with their words. Whole texts only;
    working memory is a small multiple of the slice."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), scan_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def gram_ranges(first: np.ndarray, size: int, whole_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges of every ``size``-word window inside one document, as
    (start, end, window offsets by document). With ``whole_short`` a document
    of 1 to size - 1 words gives its whole sequence as one range."""
    n = np.diff(first)
    count = np.maximum(n - size + 1, 0)
    short = (n > 0) & (n < size) if whole_short else np.zeros(len(n), bool)
    count = np.where(short, 1, count)
    by_doc = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=by_doc[1:])
    start = np.repeat(first[:-1] - by_doc[:-1], count) + np.arange(by_doc[-1])
    width = np.repeat(np.where(short, n, size), count)
    return start, start + width, by_doc


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())
