"""Operator 6: token-id files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id (ties by a hash of the text),
so partition order is id order. A task writes records of about
``record_ids`` ids: the concatenated ids, 2 bytes each when the vocabulary
allows, the end of each document as an Elias-Fano sequence, and the ascending
document ids as another. A sequence of n values below u takes about
2 + log2(u / n) bits a value; every ``SELECT_STEP``-th one's place is sampled,
so any boundary is found by a short scan and no 64-bit table exists.

Records are rows (part, seq, before, n_docs, n_ids, null_ids, payload) of a Parquet folder
that any store Spark reaches can hold. ``before`` counts the ids of earlier
records of the same part; the total of earlier parts is one small table with a
row for each write task, so readers place every document in the whole stream
without a shuffle of payloads.

Edge cases: a null text is empty and holds the end id alone; a null id sorts
last and comes back as null; rows that share an id all appear, in hash order;
one very long text makes a record of its own; extra columns are ignored; an
empty table writes no record and reads back as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featflow.llm.encode import encoder, small_batches

MAGIC = b"EFT1"
SELECT_STEP = 256
RECORD_IDS = 1 << 18
HEADER = struct.Struct("<4sBQQqQ")            # magic, bytes an id, documents, ids, least doc id, bytes of boundaries
EF_HEADER = struct.Struct("<QQB")             # values, universe, low bits
SCHEMA = "part int, seq int, before long, n_docs long, n_ids long, null_ids boolean, payload binary"


class EliasFano:
    """A non-decreasing sequence of values in [0, universe]."""

    def __init__(self, n: int, universe: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low, self.lows, self.highs, self.samples = n, universe, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        places = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros((universe >> low) + n + 1, np.uint8)
        highs[places] = 1
        return cls(n, universe, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(highs, bitorder="little"), places[::SELECT_STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return EF_HEADER.pack(self.n, self.universe, self.low) + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, universe, low = EF_HEADER.unpack_from(raw, at)
        at += EF_HEADER.size
        sizes = ((n * low + 7) // 8, ((universe >> low) + n + 1 + 7) // 8, -(-n // SELECT_STEP) * 4)
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.uint32)):
            parts.append(np.frombuffer(raw, kind, size // kind().itemsize, at))
            at += size
        return cls(n, universe, low, *parts), at

    def _low(self, i: int) -> int:
        first = i * self.low
        last = first + self.low
        word = int.from_bytes(self.lows[first // 8:(last + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low) - 1)

    def __getitem__(self, i: int) -> int:
        """Value i by select: from the nearest sample, count set bits on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SELECT_STEP])
        left = i % SELECT_STEP
        byte, mask = at // 8, 0xFF & (0xFF << (at % 8))
        while True:
            b = int(self.highs[byte]) & mask
            ones = b.bit_count()
            if left < ones:
                for _ in range(left):
                    b &= b - 1
                place = byte * 8 + (b & -b).bit_length() - 1
                return ((place - i) << self.low) | self._low(i)
            left -= ones
            byte, mask = byte + 1, 0xFF

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[:self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low).astype(np.uint64)
        return (high | (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def pack_record(doc_ids: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    ends = np.cumsum(lengths)
    least = int(doc_ids[0])
    bounds = EliasFano.of(ends, int(ends[-1])).to_bytes()
    names = (doc_ids - least).astype(np.uint64)
    return (HEADER.pack(MAGIC, width, len(doc_ids), int(ends[-1]), least, len(bounds)) + bounds
            + EliasFano.of(names, int(names[-1])).to_bytes() + ids)


class Record:
    """A read record: ids, boundaries and document ids."""

    def __init__(self, raw: bytes):
        magic, width, self.n_docs, self.n_ids, least, _ = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token record")
        self.bounds, at = EliasFano.from_bytes(raw, HEADER.size)
        self.names, at = EliasFano.from_bytes(raw, at)
        self.least = least
        self.ids = np.frombuffer(raw, {2: "<u2", 4: "<u4"}[width], self.n_ids, at)

    def doc_ids(self) -> np.ndarray:
        return (self.names.all().astype(np.uint64) + np.uint64(self.least & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i - 1] if i else 0:self.bounds[i]]


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, record_ids: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], enc.dtype).tobytes()
    width = enc.dtype.itemsize
    part = TaskContext.get().partitionId()
    seq = before = 0
    names: list[int] = []
    raws: list[bytes] = []
    held, null = 0, False

    def record() -> pa.RecordBatch:
        nonlocal seq, before, held
        lengths = np.array([len(r) // width for r in raws], np.int64)
        payload = pack_record(np.array(names, np.int64), lengths, b"".join(raws), width)
        row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_docs": len(raws), "n_ids": int(lengths.sum()),
                                           "null_ids": null, "payload": payload}],
                                         schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()),
                                                           ("n_ids", pa.int64()), ("null_ids", pa.bool_()), ("payload", pa.binary())]))
        seq, before, held = seq + 1, before + int(lengths.sum()), 0
        names.clear()
        raws.clear()
        return row

    for batch in batches:
        docs, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            name, text = docs[i].as_py(), texts[i].as_py()
            if raws and (held >= record_ids or (name is None) != null):
                yield record()
            null = name is None
            names.append(0 if null else name)
            raws.append(enc.bytes_of(text or "") + end)
            held += len(raws[-1]) // width
    if raws:
        yield record()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 record_ids: int = RECORD_IDS) -> None:
    """Encode every text, append ``end_id`` and write the records to ``out``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    with small_batches(docs.sparkSession):
        (own.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(partial(_write, path=tokenizer, end_id=end_id, record_ids=record_ids), SCHEMA)
            .write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(out))


def _read(batches: Iterator[pa.RecordBatch], crc: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, start, null in zip(batch.column("payload"), batch.column("start").to_pylist(), batch.column("null_ids").to_pylist()):
            rec = Record(raw.as_buffer().to_pybytes())
            ends = rec.bounds.all()
            starts = np.concatenate([[0], ends[:-1]])
            names = rec.doc_ids()
            cols = [pa.array([None] * len(names), pa.int64()) if null else pa.array(names, pa.int64()),
                    pa.array(starts + start, pa.int64()), pa.array(ends - starts, pa.int64())]
            wide = rec.ids.astype("<u4")
            if crc:
                cols.append(pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()))
            else:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(wide.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32" if crc else "ids"])


def read_tokens(spark: SparkSession, path: str, crc: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the records at
    ``path``; with ``crc`` the CRC-32 of the ids as 32-bit little-endian
    integers instead of the ids. The table of parts that is broadcast has one
    row for each task that wrote records."""
    records = spark.read.schema(SCHEMA).parquet(path)
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = records.join(F.broadcast(parts), "part").select("payload", "null_ids", (F.col("base") + F.col("before")).alias("start"))
    last = "ids_crc32 long" if crc else "ids array<long>"
    return placed.mapInArrow(partial(_read, crc=crc), f"doc_id long, start long, n_tokens long, {last}")
