"""Operator 7: bulk-synchronous best-fit packing into sequences.

A document is its ids and an end id; only one longer than ``capacity`` is cut,
into pieces of ``capacity`` of which the first may be shorter. Pieces are then
matched to gaps, in rounds: the longest pieces not yet placed are swept along
the gaps sorted by size, each taking its successor (the least gap that holds
it); what finds none opens sequences; gaps shrink; the next round follows.

Lengths are whole numbers up to ``capacity``, so pieces of one length and gaps
of one size are interchangeable and a round treats them as runs. The only
state of the sweeps is then a run list: how many pieces have a length (one
aggregate, at most ``capacity`` rows) and which consecutive sequences have a
gap. The sweeps over this bounded list plan on counts; no piece, document or
text goes through the driver. Which piece takes which place in a run is
settled by its rank among the pieces of its length. Ranks are exact and
distributed: pieces are numbered inside hashed buckets of a length
(``BUCKET`` pieces each on average, so a length that a third of all pieces
share is spread), and bucket counts give the offsets.

The run table has a few rows for each length whatever the input, so it is
broadcast (its size is checked).

Edge cases: a null or empty text is one piece holding the end id alone; ids may
be null and rows may repeat, each row is packed; pieces of equal rank order
are identical rows, so any order gives the same result; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featflow.llm.encode import encoder, small_batches
from featflow.llm.store import written

CAPACITY = 2048
BUCKET = 20_000
MAX_RUNS = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        rows: list[tuple] = []
        blobs: list[bytes] = []
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = np.append(enc.ids(text.as_py() or ""), end_id).astype("<u4")
            first = len(ids) % capacity if len(ids) > capacity else len(ids)
            cuts = [0, *range(first or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                raw = ids[a:b].tobytes()
                rows.append((name, k, a, b - a, zlib.crc32(raw)))
                if with_ids:
                    blobs.append(raw)
        cols = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(blobs, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def best_fit_runs(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds of the sweep over (length, count). Returns runs (length,
    first rank, pieces, first sequence, offset): piece first + i of a length
    goes to sequence first_sequence + i at that offset.

    A gap list holds runs of consecutive sequences with the same free space.
    A gap that takes a piece and still holds another of that length is again
    the least one, so a sequence is filled before the next is tried."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]      # free space -> (first sequence, sequences)
    sizes: list[int] = []                                                        # sorted free spaces in use
    runs, opened = [], 0
    from bisect import bisect_left, insort

    def give_back(space: int, first: int, number: int) -> None:
        if space and number:
            if not gaps[space]:
                insort(sizes, space)
            gaps[space].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(space: int, first: int, number: int) -> int:
            """Places pieces into ``number`` sequences from ``first`` on; the number of sequences used."""
            nonlocal rank, left
            each = space // length
            full = min(number, left // each)
            for turn in range(each):
                if full:
                    runs.append((length, rank, full, first, capacity - space + turn * length))
                    rank += full
            left -= full * each
            give_back(space - each * length, first, full)
            if full < number and left:
                for turn in range(left):                 # fewer than ``each``: the last sequence used
                    runs.append((length, rank, 1, first + full, capacity - space + turn * length))
                    rank += 1
                give_back(space - left * length, first + full, 1)
                left, full = 0, full + 1
            return full

        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                break
            space = sizes[at]
            first, number = gaps[space].pop()
            if not gaps[space]:
                del sizes[at]
            used = fill(space, first, number)
            give_back(space, first + used, number - used)
        if left:
            opened += fill(capacity, opened, left)
    return runs


def ranked(pieces: DataFrame, counts: Mapping[int, int]) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... among the pieces of a length."""
    spark = pieces.sparkSession
    big = [(int(k), int(-(-n // BUCKET))) for k, n in counts.items() if n > BUCKET]
    split = F.lit(1)
    if big:      # a literal table of at most ``capacity`` entries
        table = F.broadcast(spark.createDataFrame(big, "length long, buckets long"))
        pieces = pieces.join(table, "length", "left")
        split = F.coalesce("buckets", F.lit(1))
    d = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), split))
    w = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (d.withColumn("row", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
             .withColumn("rank", F.col("row") + F.col("before")).drop("bucket", "buckets", "row", "before"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each
    piece; with ``with_ids`` also its ids as 32-bit little-endian integers."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = own.mapInArrow(partial(_pieces, path=tokenizer, end_id=end_id, capacity=capacity, with_ids=with_ids),
                          PIECES + (", ids binary" if with_ids else ""))
    with small_batches(spark):
        pieces, _ = written(made, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    runs = best_fit_runs(counts, capacity)
    if len(runs) > MAX_RUNS:
        raise ValueError(f"{len(runs)} runs are too many to broadcast")
    table = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in runs], pa.int64()) for i, n in
                                            enumerate(("length", "from_rank", "number", "first_sequence", "offset"))}))
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from_rank", "first_sequence", "offset"))).alias("runs"))
    placed = ranked(pieces, counts).join(F.broadcast(by_length), "length")
    # Runs of a length are consecutive in rank: the last one that begins at or before the rank holds it.
    run = F.element_at(F.filter("runs", lambda r: r["from_rank"] <= F.col("rank")), -1)
    out = placed.withColumn("run", run)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("run.first_sequence") + F.col("rank") - F.col("run.from_rank")).alias("sequence_id"),
                      F.col("run.offset").alias("offset"), *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, from ``pack``
    with ``with_ids``; a sequence holds at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts["ids"], F.lit(b""), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
