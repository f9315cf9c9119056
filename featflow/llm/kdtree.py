"""Operator 10: exact top-k inner products by KD-trees, one for each shard.

Vectors become whole numbers (floor(scale * x)) and are spread over shards by
a hash of their id. A shard's tree splits its points at the median of the
widest dimension until ``leaf`` points are left; leaves keep tight bounding
boxes. For a query q no point of a box scores above
sum(max(q * low, q * high)), so leaves are visited best bound first and a
query stops when the next bound is below its k-th score so far. Queries come
in blocks: the bounds of a block are two matrix products, and queries that
visit the same leaf share one.

The query set is given (ids divisible by ``every``). Each block first searches
the shard its queries live in; the k-th scores found there travel with the
block to all other shards and prune them from the start. A query leaves at
most k rows for each shard, and one window picks the best k.

Scores are exact: products use float64 while no sum can pass 2^53, else
64-bit integers. Nothing is approximated, and a hash keeps shards even.

Edge cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without an id; rows that share an id are
one vector (the smallest); vectors shorter than the longest count as padded
with zeros; equal scores go to the smaller id; fewer than k others give all of
them; scaled components above 2^31 are refused with an error; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featflow.llm.store import written

SCALE, EVERY, K = 1024, 100, 10
SHARD_VALUES = 1 << 21          # components in a shard: 8 MB as 32-bit integers
LEAF, BLOCK = 256, 512
NONE = -(1 << 62)          # below any score; its negation fits too


def build_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points by leaf, and leaf offsets."""
    order = np.arange(len(points))
    done, todo = [], [order]
    while todo:
        own = todo.pop()
        spread = points[own].max(axis=0) - points[own].min(axis=0) if len(own) > leaf else None
        if spread is None or not spread.any():
            done.append(own)
            continue
        axis = int(spread.argmax())
        middle = len(own) // 2
        own = own[np.argpartition(points[own, axis], middle)]
        todo += [own[middle:], own[:middle]]
    return np.concatenate(done), np.concatenate([[0], np.cumsum([len(d) for d in done])])


class Shard:
    """A shard's tree: ids and points by leaf, and the leaves' boxes."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaves: np.ndarray):
        self.ids, self.points, self.leaves = ids, points, leaves
        self.low = np.minimum.reduceat(points, leaves[:-1], axis=0)
        self.high = np.maximum.reduceat(points, leaves[:-1], axis=0)
        self.top = int(np.abs(points).max(initial=0))

    def search(self, own: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best k (scores, ids) of each query, absent ones NONE; scores below
        ``kth`` may be left out. Ties go to smaller ids."""
        limit = self.top * int(np.abs(q).max(initial=0)) * q.shape[1]
        if limit >= 1 << 61:
            raise OverflowError("scores do not fit 64 bits")
        kind = np.float64 if limit < 1 << 53 else np.int64
        q = q.astype(kind)
        bound = (np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T).astype(np.int64)
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(q), k), NONE, np.int64)
        names = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        kth = kth.copy()
        rows = np.arange(len(q))
        for step in range(order.shape[1]):
            leaf = order[:, step]
            live = bound[rows, leaf] >= kth
            if not live.any():
                break
            for number in np.unique(leaf[live]):
                at = np.flatnonzero(live & (leaf == number))
                a, b = self.leaves[number], self.leaves[number + 1]
                score = (q[at] @ self.points[a:b].astype(kind).T).astype(np.int64)
                ids = np.broadcast_to(self.ids[a:b], score.shape)
                score[ids == own[at][:, None]] = NONE
                s = np.concatenate([best[at], score], axis=1)
                n = np.concatenate([names[at], ids], axis=1)
                pick = np.lexsort((n, -s))[:, :k]
                best[at] = np.take_along_axis(s, pick, 1)
                names[at] = np.take_along_axis(n, pick, 1)
            kth = np.maximum(kth, best[:, k - 1])
        return best, names


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, ids, points) of rows sorted by (shard, id, values): one vector for each id."""
    shard, ids, values = None, [], []
    for batch in batches:
        col = batch.column("v")
        flat = col.flatten().to_numpy()
        for i, (s, name) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("vec_id").to_pylist())):
            if s != shard and ids:
                yield shard, np.array(ids, np.int64), np.array(values)
                ids, values = [], []
            shard = s
            if not ids or ids[-1] != name:
                ids.append(name)
                values.append(flat[i * (len(flat) // batch.num_rows):(i + 1) * (len(flat) // batch.num_rows)])
    if ids:
        yield shard, np.array(ids, np.int64), np.array(values)


def _index(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    for shard, ids, points in _groups(batches):
        order, leaves = build_tree(points, leaf)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([points.shape[1]], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()),
             pa.array([points[order].tobytes()], pa.binary()), pa.array([leaves.astype(np.int64).tobytes()], pa.binary())],
            names=["shard", "dim", "ids", "points", "leaves"])


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for shard, ids, points in _groups(batches):
        for a in range(0, len(ids), block):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([ids[a:a + block].tobytes()], pa.binary()),
                                              pa.array([points[a:a + block].tobytes()], pa.binary()), pa.array([b""], pa.binary())],
                                             names=["home", "own", "q", "kth"])


def _search(batches: Iterator[pa.RecordBatch], k: int, carry: bool) -> Iterator[pa.RecordBatch]:
    key, shard = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i] for c in ("shard", "home", "dim")}
            r = {c: v.as_py() for c, v in r.items()}
            raw = {c: batch.column(c)[i].as_buffer() for c in ("ids", "points", "leaves", "own", "q", "kth")}
            if key != r["shard"]:
                key = r["shard"]
                shard = Shard(np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["points"], np.int32).reshape(-1, r["dim"]),
                              np.frombuffer(raw["leaves"], np.int64))
            own = np.frombuffer(raw["own"], np.int64)
            q = np.frombuffer(raw["q"], np.int32).reshape(-1, r["dim"])
            kth = np.frombuffer(raw["kth"], np.int64) if raw["kth"].size else np.full(len(own), NONE + 1, np.int64)
            best, names = shard.search(own, q, k, kth)
            if carry:
                last = np.maximum(kth, best[:, k - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["home"]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (own, q, last, best, names)]],
                    names=["home", "own", "q", "kth", "best", "names"])
            else:
                yield _rows(own, best, names, kth)


def _rows(own: np.ndarray, best: np.ndarray, names: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
    real = (best > NONE) & (best >= kth[:, None])
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(own[:, None], best.shape)[real]), pa.array(names[real]), pa.array(best[real])],
                                      names=["query_id", "vec_id", "score"])


def _home_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, best, names in zip(*(batch.column(c) for c in ("own", "best", "names"))):
            own = np.frombuffer(own.as_buffer(), np.int64)
            best, names = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, k) for x in (best, names))
            yield _rows(own, best, names, np.full(len(own), NONE + 1, np.int64))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K,
          scale: int = SCALE, shard_values: int = SHARD_VALUES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    big = v.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n"),
                F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).first()
    dim, rows = big["d"] or 1, big["n"]
    if rows and big["top"] * scale >= 2 ** 31 - 1:
        raise OverflowError("scaled components do not fit 32 bits")
    shards = max(1, -(-rows * dim // shard_values))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    v = v.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", padded.alias("v"))
    by_shard = lambda df: df.repartition("shard").sortWithinPartitions("shard", "vec_id", "v")
    index, _ = written(by_shard(v).mapInArrow(partial(_index, leaf=leaf), "shard long, dim int, ids binary, points binary, leaves binary"), "kdtrees")
    asked = by_shard(v.where(F.pmod("vec_id", F.lit(every)) == 0)).mapInArrow(
        partial(_blocks, block=block), "home long, own binary, q binary, kth binary")
    tree = ["shard", "dim", "ids", "points", "leaves"]
    first = index.join(asked, index["shard"] == asked["home"]).select(*tree, "home", "own", "q", "kth")
    first, _ = written(first.mapInArrow(partial(_search, k=k, carry=True),
                                        "home long, own binary, q binary, kth binary, best binary, names binary"), "home")
    away = (first.select("home", "own", "q", "kth", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("target"))
                 .where("target <> home"))
    rest = index.join(away, index["shard"] == away["target"]).select(*tree, "home", "own", "q", "kth")
    out = "query_id long, vec_id long, score long"
    found = first.mapInArrow(partial(_home_rows, k=k), out).union(rest.mapInArrow(partial(_search, k=k, carry=False), out))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
