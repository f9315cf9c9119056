"""Operator 1: near-duplicate classes by fast similarity sketching.

Sketch. A document's set of distinct word shingles is hashed into ``bins``
bins. Round i puts every shingle into one hashed bin (after ``bins`` rounds,
into bin i - bins) with the value (i, hash); a bin keeps its least value and a
document stops as soon as no bin is empty. Long sets need one or two rounds,
and every coordinate is filled after 2 * bins rounds at the latest. Two
coordinates agree with probability J and concentrate as independent ones do.

Banding. ``bands`` groups of ``rows`` coordinates make bucket keys. With the
defaults (36 x 6) a pair at J = 0.85 misses all buckets with probability
4e-8. Documents with equal sets share one representative first, so copies
never meet in a bucket. Buckets only say which representatives may be linked:
each links to the smallest of its bucket (no pairs), and the components of
that graph are the candidate clusters.

Verification. Full sets are compared exactly inside clusters. A cluster above
``block_docs`` documents or ``block_shingles`` shingles is split into hashed
blocks, one task group for each pair of blocks, so a group holds at most about
two blocks whatever the cluster's size. A group returns only a spanning forest
of its links, never the pairs. Components of the links are the classes.

Edge cases: a null or wordless text has an empty set and is linked with
nothing; texts with fewer words than ``ngram`` are one shingle; rows that
share an id count as one document (each still gets its row); a row without an
id takes no part in links, has a null component and is kept; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featflow.llm import text as T
from featflow.llm.graph import components
from featflow.llm.order import positions
from featflow.llm.store import written

NGRAM, BANDS, ROWS = 5, 36, 6
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE = np.uint64((1 << 54) - 1)


def shingle_sets(words: T.Words, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, and their offsets."""
    start, end, by_doc = T.gram_ranges(words.first, ngram, whole_short=True)
    flat = T.range_hashes(words.hashes(lower=True), start, end, T.BASE_WORDS)
    for a, b in zip(by_doc[:-1], by_doc[1:]):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[by_doc[:-1][by_doc[:-1] < len(flat)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return flat[fresh], kept[by_doc]


def similarity_sketch(sets: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """The (documents x bins) sketch; rows of empty sets stay unfilled."""
    n = len(offsets) - 1
    sketch = np.full(n * bins, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    left = sets
    for i in range(2 * bins):
        if not len(left):
            break
        x = T.mix64(left ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_ = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(sketch, doc * bins + bin_, np.uint64(i << 54) | (x & _VALUE))
        open_ = (sketch.reshape(n, bins) == _EMPTY).any(axis=1)
        more = open_[doc]
        if not more.all():
            left, doc = left[more], doc[more]
    return sketch.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    parts = sketch.reshape(len(sketch), bands, rows)
    for r in range(rows):
        h = T.mix64(h * np.uint64(T.BASE_WORDS) + parts[:, :, r])
    return h


def _sketch_rows(batches: Iterator[pa.RecordBatch], ngram: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in T.blocks(batch):
            sets, off = shingle_sets(words, ngram)
            size = np.diff(off)
            full = size > 0
            sums = []
            for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                total = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(T.mix64(sets ^ np.uint64(salt)), out=total[1:])
                sums.append(total[off[1:]] - total[off[:-1]])
            keys = band_keys(similarity_sketch(sets, off, bands * rows)[full], bands, rows)
            ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            none = pa.array(~full)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size.astype(np.int64)),
                 pc.if_else(none, None, T.as_long(sums[0])), pc.if_else(none, None, T.as_long(sums[1])),
                 pa.ListArray.from_arrays(pa.array(ends), T.as_long(keys.ravel()))],
                names=["doc_id", "n_shingles", "f1", "f2", "keys"])


def _set_rows(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in T.blocks(batch):
            sets, off = shingle_sets(words, ngram)
            raw = [sets[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("cluster"), part.column("blocks"), pa.array(raw, pa.binary())],
                names=["node", "cluster", "blocks", "items"])


def link_forest(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], across: bool,
                num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links den * |A & B| >= num * |A | B| among
    ``nodes`` (only between the two sides when ``across``)."""
    order = np.argsort(side, kind="stable")
    nodes, side, sets = nodes[order], side[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(universe), bool)
    split = int(np.searchsorted(side, side[-1])) if across else 0
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    for i in range(split if across else len(nodes) - 1):
        lo = split if across else i + 1
        mine = ids[off[i]:off[i + 1]]
        flag[mine] = True
        common = np.add.reduceat(flag[ids[off[lo]:]], off[lo:-1] - off[lo], dtype=np.int64)
        flag[mine] = False
        for j in np.flatnonzero(den * common >= num * (size[i] + size[lo:] - common)) + lo:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((int(nodes[i]), int(nodes[j])))
    return forest


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, bi, bj): one group at a time is held."""
    key, nodes, side, items, out = None, [], [], [], []

    def flush() -> None:
        if len(nodes) > 1:
            out.extend(link_forest(np.array(nodes), np.array(side), [np.frombuffer(x, np.uint64) for x in items],
                                   key[1] != key[2], num, den))

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
                                          names=["a", "b"])
        out.clear()
        return made

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("cluster", "bi", "bj", "node", "blk", "items")]
        for c, i, j, n, b, x in zip(*cols):
            if (c, i, j) != key:
                if key is not None:
                    flush()
                key, nodes, side, items = (c, i, j), [], [], []
            if x:
                nodes.append(n)
                side.append(b)
                items.append(x)
        if len(out) > 10_000:
            yield rows()
    if key is not None:
        flush()
    yield rows()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
                    num: int = 85, den: int = 100, bands: int = BANDS, rows: int = ROWS,
                    block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``;
    documents are linked when den * |A & B| >= num * |A | B|."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches, _ = written(own.mapInArrow(
        partial(_sketch_rows, ngram=ngram, bands=bands, rows=rows),
        "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "sketches")
    reps = (sketches.where("f1 is not null and doc_id is not null").groupBy("f1", "f2")
            .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "n_shingles", "keys")).alias("r"))
            .select("f1", "f2", "copies", F.col("r.doc_id").alias("node"), F.col("r.n_shingles").alias("n"), F.col("r.keys").alias("keys")))
    reps, _ = written(reps, "representatives")

    places = reps.select("node", F.explode("keys").alias("key"))
    buckets = places.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    near = places.join(buckets, "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
    member = components(near)

    sized = reps.groupBy("node").agg(F.max("n").alias("n")).join(member, "node")
    total = sized.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_shingles),
                                                 F.ceil(F.count(F.lit(1)) / block_docs)).cast("int").alias("blocks"))
    sized = sized.join(total, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"), "blocks")
    sets = own.join(sized, "doc_id").mapInArrow(partial(_set_rows, ngram=ngram),
                                                "node long, cluster long, blocks int, items binary")
    blk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = (sets.withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("cluster", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "node", "blk", "items"))
    links = (pairs.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
                  .mapInArrow(partial(_verify, num=num, den=den), "a long, b long"))
    classes = components(links)

    named = (reps.select("f1", "f2", "copies", "node").join(classes, "node", "left")
                 .where("copies > 1 or root is not null").select("f1", "f2", F.coalesce("root", "node").alias("component")))
    found = sketches.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the smallest id stays, once;
    rows without an id all stay. Where ids repeat, rows are told apart by their
    place in the order of (id, hash of the text), so a row goes only if its own
    text has a copy that stays."""
    known, loose = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    name, columns = id_col, docs.columns
    if known.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        name = "__row"
        known = positions(known.withColumn("__hash", F.xxhash64(text_col)), [], [id_col, "__hash"], name, "rows")
    found = near_duplicates(known, id_col=name, text_col=text_col, **options)
    keep = found.where("kept").select(F.col("doc_id").alias(name)).distinct()
    return known.join(keep, name, "left_semi").select(*columns).unionByName(loose)
