"""Extremely randomised trees (J4): one random cut a node and feature.

All trees grow a level together, on raw feature values, without bins and
without bootstrap. A level is two aggregates: the least and the largest value
of the drawn features in every open node, then the class weights left of a cut
drawn uniformly between them. Both are arrays (node x drawn feature) added up
over partitions, so what reaches the driver is bounded by the open nodes, not
by the rows. Draws depend on the seed, the tree, the node and the feature
alone, so a fit can be repeated. The cut with the largest Gini gain splits the
node; a missing value goes right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featflow.operators.base import StatEstimator, StatModel
from featflow.operators.boosting import matrix

DEFAULTS = {"label": "label", "features": "features", "weight": None, "trees": 50, "max_depth": 10, "min_rows_split": 2, "min_rows_leaf": 1,
            "max_features": "sqrt", "seed": 42}
DIRECT_BYTES = 32 << 20


def drawn_features(seed: int, tree: int, path: int, width: int, count: int) -> np.ndarray:
    """The features looked at in a node; ``path`` numbers it as in a heap."""
    return np.random.default_rng([seed, 1, tree, path]).choice(width, count, replace=False)


def drawn_cuts(seed: int, tree: int, path: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A cut in [low, high) for each drawn feature of a node."""
    u = np.random.default_rng([seed, 2, tree, path]).random(len(low))
    with np.errstate(invalid="ignore"):
        return np.minimum(low + u * (high - low), np.nextafter(high, -np.inf))


def route(x: np.ndarray, tree: dict) -> np.ndarray:
    """The node of each row (a missing value goes right). Leaves lead to
    themselves, so a level is one step of all rows."""
    n = len(x)
    flat, rows = np.ascontiguousarray(x.T).reshape(-1), np.arange(n)        # no copy of values laid out by feature
    first, cut, kid = tree["feature"].clip(0) * n, tree["cut"], tree["kid"]
    node, at, cut_at, value = np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n)
    for _ in range(tree["depth"]):
        first.take(node, out=at, mode="clip")
        at += rows
        cut.take(node, out=cut_at, mode="clip")
        flat.take(at, out=value, mode="clip")
        node *= 2
        node += value <= cut_at
        kid.take(node, out=at, mode="clip")
        node, at = at, node
    return node


def _arrays(tree: dict) -> dict:
    """``kid``: where a row goes from a node, right and left in turn."""
    feature, left, right = (np.array(tree[c], np.int64) for c in ("feature", "left", "right"))
    own = np.arange(len(feature))
    kid = np.stack([np.where(feature >= 0, right, own), np.where(feature >= 0, left, own)], axis=1).reshape(-1)
    depth, level = 0, [0]
    while level := [k for i in level if feature[i] >= 0 for k in (left[i], right[i])]:
        depth += 1
    return {"feature": feature, "cut": np.array([0.0 if c is None else c for c in tree["cut"]]), "kid": kid, "depth": depth}


def _level(batches: Iterator[pa.RecordBatch], trees: list[dict], open_: list[dict], cuts: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """(tree, part, sums): ranges as (low, -high) or class weights left of the cuts."""
    sums = [np.full((*o["features"].shape, 2), np.inf) if cuts is None else np.zeros((*o["features"].shape, 3)) for o in open_]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = np.asfortranarray(matrix(batch.column("x")))
        flat = x.T.reshape(-1)
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        # rows of weight 1 and class 0 or 1 are counted, others weighed
        side = y == 1 if (w == 1).all() and ((y == 0) | (y == 1)).all() else None
        for t, (tree, o) in enumerate(zip(trees, open_)):
            m, k = o["features"].shape
            if not m:
                continue
            slot = np.full(len(tree["feature"]), m, np.uint16 if m < 1 << 16 else np.int64)
            slot[o["nodes"]] = np.arange(m)
            at = slot.take(route(x, tree), mode="clip")
            rows = np.argsort(at, kind="stable")                               # by open node; the others at the end
            size = np.bincount(at, minlength=m + 1)[:m]
            rows = rows[:size.sum()]
            met = np.flatnonzero(size)
            if not len(met):
                continue
            starts, weigh = np.cumsum(size[met]) - size[met], None
            if cuts is not None and side is not None:
                weigh = side[rows]
            elif cuts is not None:
                weigh = w[rows] * (1 - y[rows]), w[rows] * y[rows]
            for j in range(k):
                v = flat.take(np.repeat(o["features"][:, j] * n, size) + rows, mode="clip")
                if cuts is None:                                               # fmin and fmax pass over missing values
                    sums[t][met, j, 0] = np.fmin(sums[t][met, j, 0], np.fmin.reduceat(v, starts))
                    sums[t][met, j, 1] = np.fmin(sums[t][met, j, 1], -np.fmax.reduceat(v, starts))
                    continue
                goes = v <= np.repeat(cuts[t][:, j], size)
                count = np.add.reduceat(goes, starts, dtype=np.int64)
                if side is not None:
                    one = np.add.reduceat(goes & weigh, starts, dtype=np.int64)
                    sums[t][met, j] += np.stack([count - one, one, count], axis=1)
                else:
                    sums[t][met, j] += np.stack([*(np.add.reduceat(np.where(goes, c, 0.0), starts) for c in weigh), count], axis=1)
    part = TaskContext.get().partitionId()
    live = [t for t, s in enumerate(sums) if s.size]
    yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([part] * len(live), pa.int32()),
                                      pa.array([sums[t].tobytes() for t in live], pa.binary())], names=["tree", "part", "sums"])


def _merged(batches: Iterator[pa.RecordBatch], least: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, part): one array a tree."""
    key, total = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["tree", "sums"])

    for batch in batches:
        for t, raw in zip(batch.column("tree").to_pylist(), batch.column("sums").to_pylist()):
            if t != key:
                if key is not None:
                    yield made()
                key, total = t, np.frombuffer(raw).copy()
            else:
                total = np.minimum(total, np.frombuffer(raw)) if least else total + np.frombuffer(raw)
    if key is not None:
        yield made()


def level_sums(rows: DataFrame, trees: list[dict], open_: list[dict], cuts: list[np.ndarray] | None) -> list[np.ndarray]:
    """One aggregate over all trees: ranges without ``cuts``, else class weights and rows on the left."""
    depth = 2 if cuts is None else 3
    shapes = [(*o["features"].shape, depth) for o in open_]
    out = [np.full(s, np.inf) if cuts is None else np.zeros(s) for s in shapes]
    parts = rows.mapInArrow(partial(_level, trees=trees, open_=open_, cuts=cuts), "tree int, part int, sums binary")
    direct = rows._jdf.rdd().getNumPartitions() * sum(o.nbytes for o in out) <= DIRECT_BYTES
    if not direct:
        parts = parts.repartition("tree").sortWithinPartitions("tree", "part").mapInArrow(partial(_merged, least=cuts is None), "tree int, sums binary")
    for r in sorted(parts.collect(), key=lambda r: r["part"]) if direct else parts.toLocalIterator():
        got = np.frombuffer(r["sums"]).reshape(shapes[r["tree"]])
        out[r["tree"]] = np.minimum(out[r["tree"]], got) if cuts is None else out[r["tree"]] + got
    return out


def gini_gain(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Decrease of weighted Gini impurity, by (node, feature), from class weights."""
    right = total[:, None, :] - left

    def impurity(c: np.ndarray) -> np.ndarray:
        s = c.sum(axis=-1)
        return np.where(s > 0, s - (c ** 2).sum(axis=-1) / np.where(s > 0, s, 1), 0.0)

    return impurity(total)[:, None] - impurity(left) - impurity(right)


class ExtraTreesModel(StatModel):
    def apply(self, df, conf, stats):
        conf = DEFAULTS | conf
        trees = [(_arrays(t), np.array(t["share"])) for t in stats["trees"]]

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            values = np.vstack(x.to_numpy()).astype(np.float64)
            return pd.Series(sum(s[route(values, t)] for t, s in trees) / len(trees))

        p = F.col("_share")
        scored = df.withColumn("_share", share(vector_to_array(F.col(conf["features"]))))
        return scored.withColumn("probability", array_to_vector(F.array(1.0 - p, p))).withColumn("prediction", (p >= 0.5).cast("double")).drop("_share")

    @property
    def featureImportances(self):
        """Mean normalised impurity decrease by feature, as a vector."""
        from pyspark.ml.linalg import Vectors
        stats = self.fitted
        total = np.zeros(stats["width"])
        for t in stats["trees"]:
            own = np.zeros(stats["width"])
            for f, g in zip(t["feature"], t["gain"]):
                if f >= 0:
                    own[f] += g
            total += own / (own.sum() or 1.0)
        return Vectors.dense(total / (total.sum() or 1.0))


class ExtraTrees(StatEstimator):
    """Settings as in DEFAULTS; ``max_features``: "sqrt", "all" or a number."""

    model_class = ExtraTreesModel

    def compute(self, df, conf):
        conf = DEFAULTS | conf
        weight = F.col(conf["weight"]).cast("double") if conf["weight"] else F.lit(1.0)
        rows = df.select(vector_to_array(F.col(conf["features"])).alias("x"), F.col(conf["label"]).cast("double").alias("y"), weight.alias("w")) \
                 .where("y is not null and w > 0").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            first = rows.agg(F.max(F.size("x")).alias("width"), F.sum(F.col("w") * (1 - F.col("y"))).alias("c0"), F.sum(F.col("w") * F.col("y")).alias("c1"),
                             F.count(F.lit(1)).alias("n")).first()
            if not first["n"]:
                raise ValueError("extra trees need training rows")
            return self._grow(rows, conf, first["width"], [first["c0"], first["c1"], first["n"]])
        finally:
            rows.unpersist()

    @staticmethod
    def _grow(rows: DataFrame, conf: dict, width: int, total: Sequence[float]) -> dict:
        k = {"sqrt": max(1, int(math.sqrt(width))), "all": width}.get(conf["max_features"], conf["max_features"])
        seed, count = conf["seed"], conf["trees"]
        trees = [{"feature": [-1], "cut": [None], "left": [-1], "right": [-1], "gain": [0.0], "sums": [list(total)], "path": [1]} for _ in range(count)]
        fresh = [[0] for _ in range(count)]
        for _ in range(conf["max_depth"]):
            open_ = []
            for t, tree in enumerate(trees):
                nodes = [n for n in fresh[t] if tree["sums"][n][2] >= conf["min_rows_split"] and min(tree["sums"][n][:2]) > 0]
                features = [drawn_features(seed, t, tree["path"][n], width, k) for n in nodes]
                open_.append({"nodes": np.array(nodes, np.int64), "features": np.array(features, np.int64).reshape(len(nodes), k)})
            if not any(len(o["nodes"]) for o in open_):
                break
            arrays = [_arrays(t) for t in trees]
            ranges = level_sums(rows, arrays, open_, None)
            cuts = []
            for t, (o, r) in enumerate(zip(open_, ranges)):
                own = [drawn_cuts(seed, t, trees[t]["path"][n], r[i, :, 0], -r[i, :, 1]) for i, n in enumerate(o["nodes"])]
                cuts.append(np.array(own).reshape(len(own), k))
            lefts = level_sums(rows, arrays, open_, cuts)
            fresh = []
            for o, r, c, left, tree in zip(open_, ranges, cuts, lefts, trees):
                made: list[int] = []
                if len(o["nodes"]):
                    sums = np.array([tree["sums"][n] for n in o["nodes"]])
                    gain = gini_gain(left[:, :, :2], sums[:, :2])
                    rows_right = sums[:, None, 2] - left[:, :, 2]
                    ok = (r[:, :, 0] < -r[:, :, 1]) & (left[:, :, 2] >= conf["min_rows_leaf"]) & (rows_right >= conf["min_rows_leaf"])
                    gain = np.where(ok, gain, -np.inf)
                    best = gain.argmax(axis=1)
                    for i, n in enumerate(o["nodes"]):
                        b = best[i]
                        if not np.isfinite(gain[i, b]):
                            continue
                        tree["feature"][n], tree["cut"][n], tree["gain"][n] = int(o["features"][i, b]), float(c[i, b]), max(float(gain[i, b]), 0.0)
                        for side, part in enumerate((left[i, b], sums[i] - left[i, b])):
                            tree["left" if side == 0 else "right"][n] = len(tree["feature"])
                            made.append(len(tree["feature"]))
                            for name, value in (("feature", -1), ("cut", None), ("left", -1), ("right", -1), ("gain", 0.0), ("sums", part.tolist()),
                                                ("path", 2 * tree["path"][n] + side)):
                                tree[name].append(value)
                fresh.append(made)
        for tree in trees:
            tree["share"] = [s[1] / (s[0] + s[1]) if s[0] + s[1] > 0 else 0.5 for s in tree.pop("sums")]
            tree.pop("path")
        return {"trees": trees, "width": width}
