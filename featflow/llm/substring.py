"""Operator 2: repeated passages, by a count-min prefilter and exact groups.

Every window of ``window`` words has an anchor: the least hash among its
``anchor``-word grams. Equal windows have equal anchors at equal places, so
two windows that start at different places have different anchor places, and
an anchor's number of places is never below the number of its window's
occurrences. The prefilter counts anchors, about 2 in (window - anchor + 2)
words, instead of windows.

Pass 1 counts anchors into a count-min sketch of two rows. Tasks emit sparse
pieces of the sketch; pieces are merged in Spark by (row, piece). Counters
saturate at two, all that is asked. The merged sketch, one bit a cell (counted
twice or more), is broadcast: its size is a power of two that follows the
input up to ``max_cells`` (2 x 64 MB), a fixed bound. It only overestimates;
past the bound more windows pass, none is lost.

Pass 2 emits each window whose anchor is estimated repeated, counted within
the task first, and groups (anchor, window hash) exactly: 128 bits name a word
sequence. Groups of one occurrence are the overestimates; they name their only
place. Pass 3 removes the words of every estimated window except those.

Edge cases: a null text is empty; a text shorter than a window keeps all its
words; repeated rows are documents of their own, so all their windows repeat;
ids may be null or shared (places are keyed by a hash of id and text); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featflow.llm import text as T

WINDOW, ANCHOR = 35, 20
MAX_CELLS = 1 << 29
PIECE = 1 << 16
ROW_SALTS = (0x452821E638D01377, 0xBE5466CF34E90C6C)
FLUSH = 1 << 20


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


class Windows:
    """Anchors and windows of one block of documents."""

    def __init__(self, words: T.Words, window: int, anchor: int):
        self.window = window
        h = words.hashes()
        n = len(h) - window + 1
        self.ok = np.zeros(max(n, 0), bool)
        self.n = max(n, 0)
        if n <= 0:
            return
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= window:
                self.ok[a:b - window + 1] = True
        i = np.arange(len(h) - anchor + 1)
        self.gram = T.range_hashes(h, i, i + anchor, T.BASE_WORDS) | np.uint64(1)
        span = window - anchor + 1
        self.least = sliding(self.gram, span, np.minimum)
        seen = np.where(self.ok, self.least, np.uint64(0))
        padded = np.concatenate([np.zeros(span - 1, np.uint64), seen, np.zeros(span - 1, np.uint64)])
        self.places = sliding(padded, span, np.maximum) == self.gram
        self._h = h

    def anchors(self) -> np.ndarray:
        return self.gram[self.places] if self.n else np.zeros(0, np.uint64)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return T.range_hashes(self._h, at, at + self.window, T.BASE_BYTES)


def cell(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return T.mix64(keys ^ np.uint64(ROW_SALTS[row])) & np.uint64(cells - 1)


def _sketch(batches: Iterator[pa.RecordBatch], window: int, anchor: int, cells: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def pieces() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
        held.clear()
        for row in range(len(ROW_SALTS)):
            c, n = np.unique(cell(keys, row, cells), return_counts=True)
            piece = (c >> np.uint64(16)).astype(np.int64)
            low = (c & np.uint64(PIECE - 1)).astype(np.uint16)
            number, start = np.unique(piece, return_index=True)
            ends = np.append(start[1:], len(c))
            once = [low[a:b][n[a:b] == 1].tobytes() for a, b in zip(start, ends)]
            more = [low[a:b][n[a:b] > 1].tobytes() for a, b in zip(start, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(number), row, np.int32)), pa.array(number.astype(np.int64)),
                 pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["row", "piece", "once", "more"])

    for batch in batches:
        for _, words in T.blocks(batch):
            found = Windows(words, window, anchor).anchors()
            held.append(found)
            size += len(found)
            if size > 4 * FLUSH:
                yield from pieces()
                size = 0
    yield from pieces()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (row, piece): sums the pieces, keeps one bit a cell."""
    key, count = None, np.zeros(PIECE, np.uint8)

    def made() -> pa.RecordBatch:
        bits = np.packbits(count >= 2).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
                                           pa.array([bits], pa.binary())], names=["row", "piece", "bits"])

    for batch in batches:
        for row, piece, once, more in zip(*(batch.column(c).to_pylist() for c in ("row", "piece", "once", "more"))):
            if (row, piece) != key:
                if key is not None and (count >= 2).any():
                    yield made()
                key = (row, piece)
                count[:] = 0
            at = np.frombuffer(once, np.uint16)
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, np.uint16)] = 2
    if key is not None and (count >= 2).any():
        yield made()


def _estimated(found: Windows, sketch: list[np.ndarray], cells: int) -> np.ndarray:
    """Windows (as word positions) whose anchor is counted twice or more."""
    if not found.n:
        return np.zeros(0, np.int64)
    keys = found.least
    hit = found.ok.copy()
    for row, bits in enumerate(sketch):
        at = np.flatnonzero(hit)
        c = cell(keys[at], row, cells)
        hit[at] = (bits[(c >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return np.flatnonzero(hit)


def _candidates(batches: Iterator[pa.RecordBatch], window: int, anchor: int, cells: int, shared) -> Iterator[pa.RecordBatch]:
    sketch = shared.value
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def grouped() -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
        held.clear()
        order = np.lexsort((cols[1], cols[0]))
        a, w = cols[0][order], cols[1][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(a)))
        pick = order[at]
        # Rows leave in the order of their places: neighbours share anchor and place, which packs well.
        back = np.argsort(pick, kind="stable")
        return pa.RecordBatch.from_arrays(
            [T.as_long(a[at][back]), T.as_long(w[at][back]), T.as_long(count[back]), T.as_long(cols[2][pick][back]),
             pa.array(cols[3][pick][back].astype(np.int32))], names=["anchor", "hash", "n", "place", "pos"])

    for batch in batches:
        for part, words in T.blocks(batch):
            found = Windows(words, window, anchor)
            at = _estimated(found, sketch, cells)
            if not len(at):
                continue
            doc = np.searchsorted(words.first, at, "right") - 1
            place = part.column("place").to_numpy(zero_copy_only=False)
            held.append((found.least[at], found.hashes(at), place[doc], at - words.first[doc]))
            size += len(at)
            if size > FLUSH:
                yield grouped()
                size = 0
    yield grouped()


def _strip(batches: Iterator[pa.RecordBatch], window: int, anchor: int, cells: int, shared, texts: bool) -> Iterator[pa.RecordBatch]:
    sketch = shared.value
    for batch in batches:
        for part, words in T.blocks(batch):
            at = _estimated(Windows(words, window, anchor), sketch, cells)
            total = len(words.starts)
            single = np.zeros(total + 1, bool)
            lists = part.column("single")
            for d in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                single[words.first[d] + lists[int(d)].values.to_numpy()] = True
            at = at[~single[at]]
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge)[:total] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            n_removed = removed[words.first[1:]] - removed[words.first[:-1]]
            raw = words.data.tobytes()
            kept = []
            for d, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:])):
                own = raw[a:b].split()
                if n_removed[d]:
                    cut = gone[words.first[d]:words.first[d + 1]]
                    own = [w for w, g in zip(own, cut.tolist()) if not g]
                kept.append(b" ".join(own))
            out = [part.column("doc_id"), T.as_long(np.diff(words.first)), T.as_long(n_removed)]
            out.append(pa.array([x.decode("utf-8", "replace") for x in kept]) if texts
                       else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept" if texts else "kept_sha256"])


def sketch_cells(docs: DataFrame, max_cells: int) -> int:
    """Cells of a sketch row: a power of two from a quarter to half the bytes
    of text, 13 to 26 cells for each anchor of ordinary prose."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(max_cells, max(PIECE, 1 << int(size // 4).bit_length()))


def repeated_sketch(docs: DataFrame, window: int, anchor: int, cells: int) -> list[np.ndarray]:
    """The merged sketch as bit arrays; at most 2 x cells / 8 bytes reach the
    driver, whatever the input."""
    rows = (docs.select("text").mapInArrow(partial(_sketch, window=window, anchor=anchor, cells=cells),
                                           "row int, piece long, once binary, more binary")
                .repartition("row", "piece").sortWithinPartitions("row", "piece")
                .mapInArrow(_merge, "row int, piece long, bits binary"))
    sketch = [np.zeros(cells // 8, np.uint8) for _ in ROW_SALTS]
    for r in rows.toLocalIterator():
        sketch[r["row"]][r["piece"] * (PIECE // 8):(r["piece"] + 1) * (PIECE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return sketch


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, max_cells: int = MAX_CELLS, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; ``kept`` is the text
    left, words joined by one space. With ``texts=False`` its SHA-256 as
    ``kept_sha256`` instead."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("place", F.xxhash64("doc_id", "text"))
    cells = sketch_cells(own, max_cells)
    shared = spark.sparkContext.broadcast(repeated_sketch(own, window, anchor, cells))
    options = {"window": window, "anchor": anchor, "cells": cells, "shared": shared}
    grouped = (own.select("place", "text")
               .mapInArrow(partial(_candidates, **options), "anchor long, hash long, n long, place long, pos int")
               .repartition("anchor").groupBy("anchor", "hash")
               .agg(F.sum("n").alias("n"), F.min("place").alias("place"), F.min("pos").alias("pos")))
    single = grouped.where("n = 1").groupBy("place").agg(F.collect_list("pos").alias("single"))
    kept = "kept string" if texts else "kept_sha256 string"
    return (own.join(single, "place", "left").select("doc_id", "text", "single")
               .mapInArrow(partial(_strip, texts=texts, **options), f"doc_id long, n_words long, n_removed long, {kept}"))
