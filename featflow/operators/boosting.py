"""Second-order boosted trees over histograms, grown best leaf first.

Binning. Numeric features get quantile cuts, categorical ones a bin for each
of their most frequent levels (``bins`` - 2 of them, rarer ones share one); the
last bin is for missing and unseen values. One aggregate finds the cuts, and
every row then is a few bytes of bins, a label, a weight and a margin. Rows are
held as blocks, a record for up to an Arrow batch of them with an array for
each column, so a pass does not convert them one by one.

Growth. Gradients and hessians are made once a tree and held. A histogram pass
sums gradient, hessian and count by (node, feature, bin) inside each partition,
routing rows through the tree so far, and adds the partitions up by (node,
feature); only these sums reach the driver, at most
leaves x features x bins whatever the rows. Of two children the smaller one is
summed and the other is the difference to their parent. Leaf-wise growth takes
the open leaf with the highest gain until ``max_leaves``; passes are a level at
a time, and a leaf that the queue cannot reach any more is never summed, so
the tree is the one that splitting leaf by leaf gives. Gains and leaf values
carry the L1 and L2 penalties. Categories are sorted by gradient over hessian
and cut between different ratios, so their numbering does not matter; missing
values go to the better side.

Stopping. Margins are a column, checkpointed every ``block`` rounds, so the plan
does not grow. With a validation column the metric of every round is exact (AUC
by score counts, ties half), one job a block; training ends when the best round
lies ``patience`` rounds back, and the model keeps the trees up to it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featflow.operators.base import StatEstimator, StatModel
from featflow.operators.evaluate import auc_of_counts
from featflow.session import ensure_checkpoint_dir

DEFAULTS = {"label": "label", "features": "features", "weight": None, "validation": None, "categorical": [], "rounds": 100, "rate": 0.1,
            "max_leaves": 31, "max_depth": 8, "l1": 0.0, "l2": 1.0, "min_child_weight": 1e-3, "min_child_rows": 20, "min_gain": 0.0,
            "cat_smooth": 10.0, "subsample": 1.0, "colsample": 1.0, "bins": 64, "patience": 0, "metric": "auc", "block": 10, "seed": 42}
DIRECT_BYTES = 32 << 20
#: Blocks of rows, all held or none: bins by feature as uint8, the others as doubles.
_ROWS = "bins binary, y binary, w binary, held boolean, u binary, margin binary"
_GRADIENTS = "bins binary, g binary, h binary"


# ---- bins ----------------------------------------------------------------------------------------

def matrix(column: pa.Array) -> np.ndarray:
    """A list<double> column as a (rows, features) array; nulls are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def fit_bins(df: DataFrame, features: str, categorical: Sequence[int], bins: int) -> list[dict]:
    """A dict for each feature: {"cuts": ascending numbers} or {"levels":
    codes, most frequent first}. One aggregate for all cuts, one for all levels."""
    x = df.select(vector_to_array(F.col(features)).alias("x"))
    width = x.select(F.size("x").alias("n")).first()["n"]
    numeric = [i for i in range(width) if i not in categorical]
    found: list[dict] = [{"levels": []} for _ in range(width)]
    if numeric:
        probs = [k / (bins - 1) for k in range(1, bins - 1)]
        row = x.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), probs, 10_000).alias(str(i)) for i in numeric]).first()
        for i in numeric:
            found[i] = {"cuts": sorted(set(row[str(i)] or []))}
    if categorical:
        long = x.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col("x")[i].alias("v")) for i in categorical])).alias("s")).select("s.*")
        rank = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "v"))
        for r in long.where(~F.isnan("v")).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("k", rank).where(F.col("k") <= bins - 2) \
                     .orderBy("f", "k").collect():                      # at most features x bins rows
            found[r["f"]]["levels"].append(r["v"])
    return found


def binned(x: np.ndarray, spec: Sequence[dict], bins: int) -> np.ndarray:
    """Bins of raw values; the last is for missing values, the one before for rare or unseen levels."""
    out = np.empty(x.shape, np.uint8)
    for i, s in enumerate(spec):
        v = x[:, i]
        if "cuts" in s:
            b = np.searchsorted(np.asarray(s["cuts"]), v, side="left")
        else:
            levels = np.asarray(s["levels"], np.float64)
            order = np.argsort(levels)
            at = np.minimum(np.searchsorted(levels[order], v), max(len(levels) - 1, 0))
            b = np.where(levels[order][at] == v, order[at], bins - 2) if len(levels) else np.full(len(v), bins - 2)
        out[:, i] = np.where(np.isnan(v), bins - 1, b)
    return out


def _bin_rows(batches: Iterator[pa.RecordBatch], spec: list[dict], bins: int, start: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        b = binned(matrix(batch.column("x")), spec, bins)
        y, w, u = (batch.column(c).to_numpy() for c in ("y", "w", "u"))
        held = batch.column("held").to_numpy(zero_copy_only=False)
        blocks = [(k, np.flatnonzero(held == k)) for k in (False, True)]
        yield _batch(_ROWS, [(b[at].T.tobytes(), y[at].tobytes(), w[at].tobytes(), k, u[at].tobytes(), np.full(len(at), float(start)).tobytes())
                             for k, at in blocks if len(at)])


def _batch(schema: str, blocks: Sequence[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kind = {"binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in blocks], kind[k]) for i, k in enumerate(kinds)], names=list(names))


def _blocks(batches: Iterator[pa.RecordBatch], numbers: Sequence[str]) -> Iterator[tuple]:
    """(bins as rows x features, held or None, an array for each of ``numbers``) of every block."""
    for batch in batches:
        held = batch.column("held").to_pylist() if "held" in batch.schema.names else [None] * batch.num_rows
        for i in range(batch.num_rows):
            values = [np.frombuffer(batch.column(c)[i].as_buffer()) for c in numbers]
            b = np.frombuffer(batch.column("bins")[i].as_buffer(), np.uint8)
            yield b.reshape(-1, len(values[0])).T, held[i], *values


# ---- trees ---------------------------------------------------------------------------------------

def route(b: np.ndarray, tree: dict) -> np.ndarray:
    """The node of each row: ``tree`` is as ``as_arrays`` gives it. Leaves lead
    to themselves, so a level is one step of all rows."""
    n, bins = len(b), tree["goes_left"].shape[1]
    flat, rows = np.ascontiguousarray(b.T).reshape(-1), np.arange(n)        # blocks are stored by feature: no copy
    first, kid = tree["feature"].astype(np.int64).clip(0) * n, tree["kid"]
    node = np.zeros(n, np.int64)
    for _ in range(tree["depth"]):
        at = first[node]
        at += rows
        node *= bins
        node += flat[at]
        node = kid[node]
    return node


def as_arrays(tree: dict, bins: int) -> dict:
    """feature (-1: leaf), left, right, value, the table ``goes_left`` (node x
    bin), ``kid`` (node a bin leads to, as node * bins + bin) and ``depth``."""
    n = len(tree["feature"])
    table = np.zeros((n, bins), bool)
    for i, bs in enumerate(tree["bins_left"]):
        table[i, bs] = True
    feature, left, right = (np.array(tree[c], np.int32) for c in ("feature", "left", "right"))
    kid = np.where(feature[:, None] >= 0, np.where(table, left[:, None], right[:, None]), np.arange(n)[:, None])
    depth, level = 0, [0]
    while level := [k for i in level if feature[i] >= 0 for k in (left[i], right[i])]:
        depth += 1
    return {"feature": feature, "left": left, "right": right, "goes_left": table, "kid": kid.astype(np.int64).reshape(-1), "depth": depth,
            "value": np.array(tree["value"], np.float64)}


def margins(b: np.ndarray, trees: Sequence[dict]) -> np.ndarray:
    total, b = np.zeros(len(b)), np.asfortranarray(b)
    for t in trees:
        total += t["value"][route(b, t)]
    return total


def _gradients(batches: Iterator[pa.RecordBatch], done: list[dict], sample: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Training rows of a round with gradient and hessian."""
    share, turn = sample
    for b, held, y, w, u, margin in _blocks(batches, ("y", "w", "u", "margin")):
        if held:
            continue
        if share < 1:
            take = np.flatnonzero(np.mod(u + turn, 1.0) < share)
            b, y, w, margin = b[take], y[take], w[take], margin[take]
        if len(y):
            p = 1 / (1 + np.exp(-(margin + margins(b, done))))
            yield _batch(_GRADIENTS, [(b.T.tobytes(), (w * (p - y)).tobytes(), (w * p * (1 - p)).tobytes())])


def _histograms(batches: Iterator[pa.RecordBatch], tree: dict, build: list[int], width: int, bins: int) -> Iterator[pa.RecordBatch]:
    """(slot, feature, part, sums) of the nodes ``build``: gradient, hessian and rows by bin."""
    slot = np.full(len(tree["feature"]), -1)
    slot[build] = np.arange(len(build))
    sums = np.zeros((len(build), width, bins, 3))
    for b, _, g, h in _blocks(batches, ("g", "h")):
        at = slot[route(b, tree)]
        take = np.flatnonzero(at >= 0)
        if len(take) < len(at):
            b, at, g, h = b.T[:, take].T, at[take], g[take], h[take]
        at = at * bins
        for f in range(width):
            key = at + b[:, f]
            for k, v in enumerate((g, h, None)):
                sums[:, f, :, k] += np.bincount(key, v, minlength=len(build) * bins).reshape(len(build), bins)
    part = TaskContext.get().partitionId()
    cells = [(s, f) for s in range(len(build)) for f in range(width) if sums[s, f, :, 2].any()]
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in cells], pa.int32()), pa.array([f for _, f in cells], pa.int32()),
                                      pa.array([part] * len(cells), pa.int32()), pa.array([sums[s, f].tobytes() for s, f in cells], pa.binary())],
                                     names=["slot", "feature", "part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, feature, part): the sums, always in the same order."""
    key, total = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                          names=["slot", "feature", "sums"])

    for batch in batches:
        for s, f, raw in zip(*(batch.column(c).to_pylist() for c in ("slot", "feature", "sums"))):
            if (s, f) != key:
                if key is not None:
                    yield made()
                key, total = (s, f), np.zeros(len(raw) // 8)
            total += np.frombuffer(raw)
    if key is not None:
        yield made()


def gradients(rows: DataFrame, done: list[dict], sample: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """Blocks of the training rows with what the next tree is grown from."""
    return rows.mapInArrow(partial(_gradients, done=done, sample=sample), _GRADIENTS)


def histograms(rows: DataFrame, done: list[dict], tree: dict, build: list[int], width: int, bins: int,
               sample: tuple[float, float] = (1.0, 0.0)) -> np.ndarray:
    """(nodes, features, bins, 3) sums over the training rows."""
    return added_histograms(gradients(rows, done, sample), tree, build, width, bins)


def added_histograms(found: DataFrame, tree: dict, build: list[int], width: int, bins: int) -> np.ndarray:
    """``histograms`` of given gradients. The sums of the partitions are added
    in Spark; where all of them together are below ``DIRECT_BYTES`` the driver
    adds them, in the same order."""
    parts = found.mapInArrow(partial(_histograms, tree=tree, build=build, width=width, bins=bins), "slot int, feature int, part int, sums binary")
    out = np.zeros((len(build), width, bins, 3))
    if found._jdf.rdd().getNumPartitions() * out.nbytes <= DIRECT_BYTES:
        for r in sorted(parts.collect(), key=lambda r: r["part"]):
            out[r["slot"], r["feature"]] += np.frombuffer(r["sums"]).reshape(bins, 3)
        return out
    for r in parts.repartition("slot", "feature").sortWithinPartitions("slot", "feature", "part").mapInArrow(
            _added, "slot int, feature int, sums binary").toLocalIterator():
        out[r["slot"], r["feature"]] = np.frombuffer(r["sums"]).reshape(bins, 3)
    return out


def _worth(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return np.maximum(np.abs(g) - l1, 0) ** 2 / (h + l2)


def leaf_value(g: float, h: float, conf: dict) -> float:
    return -conf["rate"] * math.copysign(max(abs(g) - conf["l1"], 0.0), g) / (h + conf["l2"]) if h + conf["l2"] > 0 else 0.0


def best_split(hist: np.ndarray, spec: Sequence[dict], conf: dict, use: Sequence[int]) -> tuple[float, int, list[int]] | None:
    """(gain, feature, bins that go left) of a node's (features, bins, 3) sums."""
    bins, l1, l2 = hist.shape[1], conf["l1"], conf["l2"]
    best = None
    for f in use:
        total = hist[f].sum(axis=0)
        here = _worth(total[0], total[1], l1, l2)
        own, missing = hist[f, :bins - 1], hist[f, bins - 1]
        order = np.arange(bins - 1)
        cut = np.ones(bins - 2, bool)
        if "levels" in spec[f]:
            order = order[own[:, 2] > 0]
            ratio = own[order, 0] / (own[order, 1] + conf["cat_smooth"])
            by = np.argsort(ratio, kind="stable")
            order, ratio = order[by], ratio[by]
            cut = ratio[1:] > ratio[:-1]
        if len(order) < 2:
            continue
        run = np.cumsum(own[order], axis=0)[:-1]
        for missing_left in ((True, False) if missing[2] else (False,)):
            left = run + missing if missing_left else run
            right = total - left
            ok = cut & (left[:, 1] >= conf["min_child_weight"]) & (right[:, 1] >= conf["min_child_weight"])
            ok &= (left[:, 2] >= conf["min_child_rows"]) & (right[:, 2] >= conf["min_child_rows"])
            gain = np.where(ok, _worth(left[:, 0], left[:, 1], l1, l2) + _worth(right[:, 0], right[:, 1], l1, l2) - here, -np.inf) / 2
            k = int(np.argmax(gain))
            if gain[k] > conf["min_gain"] and gain[k] > 1e-12 and (best is None or gain[k] > best[0] * (1 + 1e-12)):
                goes = order[:k + 1].tolist()
                heavier = left[k, 2] >= right[k, 2]
                if missing_left or not missing[2] and heavier:
                    goes.append(bins - 1)
                if "levels" in spec[f] and heavier:
                    goes += [b for b in range(bins - 1) if own[b, 2] == 0]         # levels not met here
                best = (float(gain[k]), f, goes)
    return best


class _Growing:
    """A tree while it grows; nodes in the order of their making."""

    def __init__(self, bins: int):
        self.bins = bins
        self.hist: list[np.ndarray] = []
        self.split: list = []
        self.depth: list[int] = []
        self.kids: list[tuple[int, int] | None] = []

    def add(self, depth: int) -> int:
        for store, value in ((self.hist, None), (self.split, None), (self.depth, depth), (self.kids, None)):
            store.append(value)
        return len(self.depth) - 1

    def totals(self, node: int) -> np.ndarray:
        return self.hist[node][0].sum(axis=0)

    def picked(self, max_leaves: int) -> list[int]:
        """Splits in the order of the best-leaf queue, as far as it is known."""
        queue, found = [(-self.split[0][0], 0)] if self.split[0] else [], []
        while queue and len(found) < max_leaves - 1:
            _, node = heapq.heappop(queue)
            found.append(node)
            for kid in self.kids[node] or ():
                if self.split[kid]:
                    heapq.heappush(queue, (-self.split[kid][0], kid))
        return found

    def arrays(self, splits: Sequence[int], value) -> dict:
        """The tree of the given splits, nodes renumbered from the root."""
        keep, order = set(splits), [0]
        for node in order:
            if node in keep and self.kids[node]:
                order.extend(self.kids[node])
        at = {node: i for i, node in enumerate(order)}
        inner = [n in keep and self.kids[n] is not None for n in order]
        return {"feature": [self.split[n][1] if i else -1 for n, i in zip(order, inner)], "left": [at[self.kids[n][0]] if i else -1 for n, i in zip(order, inner)],
                "right": [at[self.kids[n][1]] if i else -1 for n, i in zip(order, inner)], "bins_left": [self.split[n][2] if i else [] for n, i in zip(order, inner)],
                "gain": [self.split[n][0] if i else 0.0 for n, i in zip(order, inner)], "value": [0.0 if i else value(n) for n, i in zip(order, inner)], "_at": at}


def grow_tree(rows: DataFrame, done: list[dict], spec: list[dict], conf: dict, number: int) -> dict:
    width = len(spec)
    rng = np.random.default_rng([conf["seed"], number])
    use = sorted(rng.choice(width, max(1, round(conf["colsample"] * width)), replace=False).tolist())
    found = gradients(rows, done, (conf["subsample"], float(rng.random()))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _grown(found, spec, conf, use)
    finally:
        found.unpersist()


def _grown(found: DataFrame, spec: list[dict], conf: dict, use: Sequence[int]) -> dict:
    bins, width = conf["bins"], len(spec)
    tree = _Growing(bins)
    tree.add(0)
    leaf = as_arrays({"feature": [-1], "left": [-1], "right": [-1], "bins_left": [[]], "value": [0.0]}, bins)
    tree.hist[0] = added_histograms(found, leaf, [0], width, bins)[0]
    fresh = [0]
    while True:
        for node in fresh:
            if tree.depth[node] < conf["max_depth"]:
                tree.split[node] = best_split(tree.hist[node], spec, conf, use)
        chosen = tree.picked(conf["max_leaves"])
        expand = [n for n in chosen if tree.kids[n] is None]
        if not expand:
            return tree.arrays(chosen, lambda n: leaf_value(*tree.totals(n)[:2], conf))
        small = []
        for node in expand:
            tree.kids[node] = (tree.add(tree.depth[node] + 1), tree.add(tree.depth[node] + 1))
            _, f, goes = tree.split[node]
            rows_left = tree.hist[node][f, goes, 2].sum()
            small.append(tree.kids[node][0 if 2 * rows_left <= tree.hist[node][f, :, 2].sum() else 1])
        known = [n for n in range(len(tree.kids)) if tree.kids[n]]
        now = tree.arrays(known, lambda n: 0.0)
        sums = added_histograms(found, as_arrays(now, bins), [now["_at"][n] for n in small], width, bins)
        fresh = []
        for node, child, hist in zip(expand, small, sums):
            other = sum(tree.kids[node]) - child
            tree.hist[child], tree.hist[other] = hist, tree.hist[node] - hist
            fresh += list(tree.kids[node])


# ---- rounds --------------------------------------------------------------------------------------

def _advance(batches: Iterator[pa.RecordBatch], trees: list[dict]) -> Iterator[pa.RecordBatch]:
    for b, held, y, w, u, margin in _blocks(batches, ("y", "w", "u", "margin")):
        yield _batch(_ROWS, [(b.T.tobytes(), y.tobytes(), w.tobytes(), held, u.tobytes(), (margin + margins(b, trees)).tobytes())])


def _staged(batches: Iterator[pa.RecordBatch], trees: list[dict], metric: str) -> Iterator[pa.RecordBatch]:
    """Validation rows by (round, score): weights of both classes, or the loss of a round."""
    for b, held, y, w, margin in _blocks(batches, ("y", "w", "margin")):
        if not held:
            continue
        m = margin.copy()
        out = []
        for k, t in enumerate(trees):
            m += t["value"][route(b, t)]
            if metric == "auc":
                score, at = np.unique(m, return_inverse=True)
                out.append((np.full(len(score), k), score, np.bincount(at, y, len(score)), np.bincount(at, 1 - y, len(score))))
            else:
                loss = w * (np.maximum(m, 0) - m * y + np.log1p(np.exp(-np.abs(m))))
                out.append((np.array([k]), np.zeros(1), np.array([loss.sum()]), np.array([w.sum()])))
        cols = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], names=["round", "score", "n_pos", "n_neg"])


def staged_metric(rows: DataFrame, trees: list[dict], metric: str) -> list[float]:
    """The metric on validation rows after each of ``trees``; higher is better."""
    counts = rows.mapInArrow(partial(_staged, trees=trees, metric=metric), "round int, score double, n_pos double, n_neg double")
    if metric == "auc":
        counts = counts.groupBy("round", "score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
        found = {r["round"]: r["auc"] for r in auc_of_counts(counts, ["round"]).collect()}
    else:
        found = {r["round"]: -r["loss"] for r in counts.groupBy("round").agg((F.sum("n_pos") / F.sum("n_neg")).alias("loss")).collect()}
    return [found.get(k) if found.get(k) is not None else -math.inf for k in range(len(trees))]


def best_round(history: Sequence[float], patience: int) -> tuple[int, bool]:
    """The first best round (from 1), and whether ``patience`` rounds have
    passed since it; rounds after that point do not count."""
    best = 0
    for k, value in enumerate(history):
        if value > history[best]:
            best = k
        if patience and k - best >= patience:
            return best + 1, True
    return best + 1, False


class BoostedTreesModel(StatModel):
    """Fitted trees; adds ``probability`` (vector), ``margin`` and ``prediction``."""

    def apply(self, df, conf, stats):
        conf = DEFAULTS | conf
        spec, bins, start = stats["spec"], conf["bins"], stats["start"]
        trees = [as_arrays(t, bins) for t in stats["trees"]]

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(start + margins(binned(np.vstack(x.to_numpy()).astype(np.float64), spec, bins), trees))

        scored = df.withColumn("margin", margin(vector_to_array(F.col(conf["features"]))))
        p = 1.0 / (1.0 + F.exp(-F.col("margin")))
        return scored.withColumn("probability", array_to_vector(F.array(1.0 - p, p))).withColumn("prediction", (p >= 0.5).cast("double"))

    @property
    def history(self) -> list[float]:
        """The validation metric of every round that was fitted."""
        return self.fitted["history"]

    @property
    def getNumTrees(self) -> int:
        return len(self.fitted["trees"])

    @property
    def featureImportances(self):
        """Summed gains by feature, as a vector."""
        from pyspark.ml.linalg import Vectors
        stats = self.fitted
        total = np.zeros(len(stats["spec"]))
        for t in stats["trees"]:
            for f, g in zip(t["feature"], t["gain"]):
                if f >= 0:
                    total[f] += g
        return Vectors.dense(total / (total.sum() or 1.0))


class BoostedTrees(StatEstimator):
    """Settings as in DEFAULTS; ``categorical`` lists positions in the feature vector."""

    model_class = BoostedTreesModel

    def compute(self, df, conf):
        conf = DEFAULTS | conf
        if not 4 <= conf["bins"] <= 256:
            raise ValueError("bins must lie between 4 and 256")
        ensure_checkpoint_dir(df.sparkSession)
        weight = F.col(conf["weight"]).cast("double") if conf["weight"] else F.lit(1.0)
        held = F.coalesce(F.col(conf["validation"]).cast("boolean"), F.lit(False)) if conf["validation"] else F.lit(False)
        x = vector_to_array(F.col(conf["features"]))
        data = df.select(x.alias("x"), F.col(conf["features"]).alias("v"), F.col(conf["label"]).cast("double").alias("y"), weight.alias("w"), held.alias("held"),
                         (F.pmod(F.xxhash64(x, F.lit(conf["seed"])), F.lit(1 << 40)) / float(1 << 40)).alias("u")).where("y is not null and w > 0")
        train = data.where("not held")
        total = train.agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("n")).first()
        if not total["n"] or not 0 < total["p"] < total["n"]:
            raise ValueError("boosting needs training rows of both classes")
        start = math.log(total["p"] / (total["n"] - total["p"]))
        spec = fit_bins(train, "v", conf["categorical"], conf["bins"])
        rows = data.drop("v").mapInArrow(partial(_bin_rows, spec=spec, bins=conf["bins"], start=start), _ROWS).persist(StorageLevel.MEMORY_AND_DISK)
        trees, history, stopped, best = [], [], False, 0
        kept = [rows]
        try:
            while len(trees) < conf["rounds"] and not stopped:
                fresh: list[dict] = []
                for number in range(len(trees), min(len(trees) + conf["block"], conf["rounds"])):
                    grown = grow_tree(rows, [as_arrays(t, conf["bins"]) for t in fresh], spec, conf, number)
                    fresh.append({k: v for k, v in grown.items() if k != "_at"})
                arrays = [as_arrays(t, conf["bins"]) for t in fresh]
                trees += fresh
                if conf["validation"]:
                    history += staged_metric(rows, arrays, conf["metric"])
                    best, stopped = best_round(history, conf["patience"])
                if len(trees) < conf["rounds"] and not stopped:
                    rows = rows.mapInArrow(partial(_advance, trees=arrays), _ROWS).checkpoint().persist(StorageLevel.MEMORY_AND_DISK)
                    kept.append(rows)
                    kept.pop(0).unpersist()
        finally:
            for r in kept:
                r.unpersist()
        return {"spec": spec, "start": start, "trees": trees[:best] if conf["validation"] else trees, "history": history}

