"""Second-order boosting, extra trees, ordered target statistics, the stack
estimator and its joint search."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featflow.operators import boosting as B
from featflow.operators import extra_trees as X
from featflow.operators import models as M
from featflow.operators import sample as S
from featflow.operators.evaluate import auc
from featflow.operators.ordered import full_target, ordered_target
from featflow.plans import stacking
from featflow.queries import modeling as Q


def table(spark, n=1500, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 12, n).astype(float)
    noise = rng.random(n)
    a[rng.random(n) < 0.1] = np.nan
    effect = np.where(np.isin(b, [1, 4, 7, 10]), 1.5, -0.8) + np.where(np.isnan(a), 1.0, np.where(a > 0.3, 1.0, -0.5))
    y = (rng.random(n) < 1 / (1 + np.exp(-effect))).astype(int)
    rows = [(i, [float(a[i]), float(b[i]), float(noise[i])], int(y[i]), bool(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>, label int, valid boolean").withColumn("features", array_to_vector("x")).repartition(4).cache()


def binned_rows(df, spec, bins):
    x = np.array([r["x"] for r in df.select("x", "label").collect()])
    return B.binned(x, spec, bins)


@pytest.mark.parametrize("direct", [True, False])
def test_histograms_equal_a_brute_force(spark, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(B, "DIRECT_BYTES", 0)
    df = table(spark)
    spec = B.fit_bins(df, "features", [1], 16)
    from functools import partial
    data = df.select("x", F.col("label").cast("double").alias("y"), F.lit(2.0).alias("w"), "valid", F.lit(0.0).alias("u")).withColumnRenamed("valid", "held")
    rows = data.select("x", "y", "w", "held", "u").mapInArrow(partial(B._bin_rows, spec=spec, bins=16, start=0.3), B._ROWS)
    tree = B.as_arrays({"feature": [2, -1, -1], "left": [1, -1, -1], "right": [2, -1, -1], "bins_left": [[0, 1, 2, 3], [], []], "value": [0, 0, 0]}, 16)
    got = B.histograms(rows, [], tree, [1, 2], 3, 16)
    want = np.zeros((2, 3, 16, 3))
    p = 1 / (1 + math.exp(-0.3))
    for r in df.where("not valid").collect():
        b = B.binned(np.array([r["x"]]), spec, 16)[0]
        node = 0 if b[2] <= 3 else 1
        for f in range(3):
            want[node, f, b[f]] += [2 * (p - r["label"]), 2 * p * (1 - p), 1]
    assert np.allclose(got, want)


def test_best_split_equals_a_brute_force():
    rng = np.random.default_rng(3)
    conf = B.DEFAULTS | {"l1": 0.4, "l2": 2.0, "min_child_rows": 3, "cat_smooth": 1.0}
    for _ in range(40):
        hist = np.zeros((2, 8, 3))
        for f in range(2):
            hist[f, :, 0], hist[f, :, 1], hist[f, :, 2] = rng.normal(size=8), rng.random(8) + 0.1, rng.integers(0, 9, 8)
            hist[f, hist[f, :, 2] == 0] = 0
        got = B.best_split(hist, [{"cuts": []}, {"levels": list(range(6))}], conf, [0, 1])
        worth = lambda s: max(abs(s[0]) - 0.4, 0) ** 2 / (s[1] + 2)
        best = 0.0
        for f in range(2):
            order = list(range(7))
            if f:
                order = sorted((b for b in order if hist[f, b, 2]), key=lambda b: hist[f, b, 0] / (hist[f, b, 1] + 1))
            for k in range(1, len(order)):
                for extra in ([], [7]):
                    left = hist[f, order[:k] + extra].sum(axis=0)
                    right = hist[f].sum(axis=0) - left
                    if min(left[2], right[2]) >= 3 and (extra == [] or hist[f, 7, 2]):
                        best = max(best, (worth(left) + worth(right) - worth(left + right)) / 2)
        assert (got is None and best <= 1e-12) or abs(got[0] - best) < 1e-9


def leaf_by_leaf(rows, spec, conf):
    """One split at a time, the open leaf with the highest gain first."""
    b, y, p = rows
    g, h = p - y, p * (1 - p)

    def hist(mask):
        out = np.zeros((b.shape[1], conf["bins"], 3))
        for f in range(b.shape[1]):
            for k, v in enumerate((g, h, np.ones(len(y)))):
                out[f, :, k] = np.bincount(b[mask, f], v[mask], minlength=conf["bins"])
        return out

    open_, splits = [(np.ones(len(y), bool), 0)], []
    while len(open_) + 0 < conf["max_leaves"]:
        found = [(B.best_split(hist(m), spec, conf, range(b.shape[1])) if d < conf["max_depth"] else None, m, d) for m, d in open_]
        found = [(s, m, d) for s, m, d in found if s]
        if not found:
            break
        s, m, d = max(found, key=lambda x: x[0][0])
        left = m & np.isin(b[:, s[1]], s[2])
        splits.append((s[1], int(left.sum()), int((m & ~left).sum())))
        open_ = [(mm, dd) for mm, dd in open_ if mm is not m] + [(left, d + 1), (m & ~left, d + 1)]
    return sorted(splits)


def test_leaf_wise_growth_is_that_of_single_splits(spark):
    df = table(spark)
    conf = B.DEFAULTS | {"bins": 16, "max_leaves": 7, "max_depth": 5, "min_child_rows": 5}
    model = B.BoostedTrees(bins=16, max_leaves=7, max_depth=5, min_child_rows=5, rounds=1, categorical=[1]).fit(df)
    spec, tree = model.fitted["spec"], B.as_arrays(model.fitted["trees"][0], 16)
    got = df.select("x", "label").collect()
    b, y = B.binned(np.array([r["x"] for r in got]), spec, 16), np.array([r["label"] for r in got], float)
    want = leaf_by_leaf((b, y, np.full(len(y), y.mean())), spec, conf)
    node = B.route(b, tree)
    counts = {int(k): int((node == k).sum()) for k in np.unique(node)}

    def size(k):
        return counts.get(k, 0) if tree["feature"][k] < 0 else size(tree["left"][k]) + size(tree["right"][k])

    inner = [k for k in range(len(tree["feature"])) if tree["feature"][k] >= 0]
    assert sorted((int(tree["feature"][k]), size(tree["left"][k]), size(tree["right"][k])) for k in inner) == want and len(inner) == 6


def test_category_numbers_do_not_matter(spark):
    df = table(spark)
    other = df.withColumn("x", F.transform("x", lambda v, i: F.when(i == 1, (v * 5 + 3) % 12).otherwise(v))).withColumn("features", array_to_vector("x"))
    make = lambda: B.BoostedTrees(rounds=4, max_leaves=8, categorical=[1], min_child_rows=5)
    a, b = (make().fit(d).transform(d).select("id", "margin").orderBy("id").collect() for d in (df, other))
    assert all(abs(x["margin"] - y["margin"]) < 1e-9 for x, y in zip(a, b))
    plain = B.BoostedTrees(rounds=4, max_leaves=8, min_child_rows=5).fit(other).transform(other).select("id", "margin").orderBy("id").collect()
    assert any(abs(x["margin"] - y["margin"]) > 1e-6 for x, y in zip(a, plain))


def test_patience_on_a_curve_that_dips_and_recovers():
    curve = [0.70, 0.74, 0.73, 0.72, 0.75, 0.74] + [0.74] * 60 + [0.76] + [0.7] * 200
    assert B.best_round(curve, 2) == (2, True)
    assert B.best_round(curve, 40) == (5, True) and B.best_round(curve, 100) == (67, True)
    assert B.best_round(curve, 200) == (67, True) and B.best_round(curve, 201) == (67, False) and B.best_round(curve[:80], 40) == (5, True)
    assert B.best_round(curve, 0) == (67, False)


def test_early_stopping_keeps_the_best_round(spark, tmp_path):
    df = table(spark)
    model = B.BoostedTrees(rounds=40, rate=0.6, max_leaves=16, min_child_rows=2, validation="valid", patience=5, block=4).fit(df)
    history = model.history
    best, stopped = B.best_round(history, 5)
    assert stopped and len(history) < 40 and model.getNumTrees == best
    scored = model.transform(df.where("valid")).select(F.col("margin").alias("score"), "label")
    assert abs(auc(scored).first()["auc"] - history[best - 1]) < 1e-12
    model.save(str(tmp_path / "model"))
    again = B.BoostedTreesModel.load(str(tmp_path / "model")).transform(df).select("id", "margin")
    assert sorted(again.collect()) == sorted(model.transform(df).select("id", "margin").collect())
    loss = B.BoostedTrees(rounds=12, validation="valid", metric="logloss", patience=3, min_child_rows=5).fit(df)
    y = np.array([r["label"] for r in df.where("valid").collect()])
    p = np.array([r["p"] for r in M.positive_probability(loss.transform(df.where("valid")), "p").collect()])
    assert abs(max(loss.history) + np.mean(np.where(y == 1, -np.log(p), -np.log(1 - p)))) < 1e-9


def test_boosting_matches_or_beats_first_order_trees(spark):
    tr, te = Q.prepared(spark, "/root/testdata/sf0.01")
    a = auc(M.positive_probability(M.gbt(max_iter=10, max_depth=4).fit(tr).transform(te)), score="probability_1").first()["auc"]
    b = auc(M.positive_probability(B.BoostedTrees(rounds=10, rate=0.3, max_leaves=16, max_depth=4).fit(tr).transform(te)), score="probability_1").first()["auc"]
    tr.unpersist()
    assert b >= a - 1e-3


def test_extra_trees(spark):
    df = table(spark)
    make = lambda seed=42: X.ExtraTrees(trees=8, max_depth=5, min_rows_leaf=3, seed=seed).fit(df)
    model = make()
    assert model.fitted["trees"] == make().fitted["trees"] and model.fitted["trees"] != make(7).fitted["trees"]
    rows = df.select("x", "label").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    for t in model.fitted["trees"]:
        inside = {0: np.ones(len(x), bool)}
        paths = {0: 1}
        number = model.fitted["trees"].index(t)
        for n in range(len(t["feature"])):
            mask = inside[n]
            assert abs(t["share"][n] - y[mask].mean()) < 1e-12
            f = t["feature"][n]
            if f >= 0:
                v = x[mask, f]
                low, high = np.nanmin(v), np.nanmax(v)
                drawn = X.drawn_features(42, number, paths[n], 3, 1)
                assert low <= t["cut"][n] < high and f in drawn
                assert t["cut"][n] == X.drawn_cuts(42, number, paths[n], np.array([low]), np.array([high]))[0]
                goes = x[:, f] <= t["cut"][n]
                for k, (side, part) in enumerate(((t["left"][n], mask & goes), (t["right"][n], mask & ~goes))):
                    inside[side], paths[side] = part, 2 * paths[n] + k
    scored = M.positive_probability(model.transform(df))
    assert auc(scored, score="probability_1").first()["auc"] > 0.7
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_extra_trees_added_up_in_spark(spark, monkeypatch):
    df = table(spark, 300)
    a = X.ExtraTrees(trees=3, max_depth=4).fit(df).fitted
    monkeypatch.setattr(X, "DIRECT_BYTES", 0)
    assert X.ExtraTrees(trees=3, max_depth=4).fit(df).fitted == a


def test_ordered_target(spark):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2] if i % 3 else "hot", i % 5 % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string, label int")
    got = {r["id"]: r["c_ots"] for r in ordered_target(df, ["c"], "id", prior_rows=2.0).collect()}
    p = sum(y for *_, y in rows) / len(rows)
    seen = {}
    for i, c, y in sorted(rows, key=lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0])):
        s, n = seen.get(c, (0, 0))
        assert abs(got[i] - (s + 2 * p) / (n + 2)) < 1e-12
        seen[c] = (s + y, n + 1)
    new = spark.createDataFrame([(1, "hot"), (2, None), (3, "never")], "id long, c string")
    full = {r["id"]: r["c_ots"] for r in full_target(df, new, ["c"], prior_rows=2.0).collect()}
    assert abs(full[1] - (seen["hot"][0] + 2 * p) / (seen["hot"][1] + 2)) < 1e-12 and full[3] == p
    assert abs(full[2] - (seen[None][0] + 2 * p) / (seen[None][1] + 2)) < 1e-12


def test_stack_search_fits_a_base_once_for_its_parameters(spark, tmp_path):
    df = S.stratified_folds(table(spark, 600).withColumn("features", array_to_vector(F.transform("x", lambda v: F.nanvl(v, F.lit(0.0))))), "id", "label", k=3, name="fold").cache()
    made = []

    def tree(depth):
        made.append(depth)
        return M.forest(num_trees=3, max_depth=depth)

    store = stacking.FoldStore(df, "id", "fold", "label", {"rf": tree, "lr": lambda C: M.logistic(C=C, n_rows=400, max_iter=5)})
    space = {"rf__depth": [2, 3], "lr__C": [1.0], "meta__C": [0.01, 0.1, 1.0, 10.0, 100.0]}
    result, best, model = stacking.joint_search(store, space, n_iter=30)
    assert result.count() == 10 and set(best) == set(space)
    assert store.fits <= 3 * 6 + 2 + 6         # three parameter settings, six nested fits each; the best stack on all rows
    assert len(made) <= 2 * 6 + 1 + 3
    before = store.fits
    stacking.joint_search(store, space, n_iter=30, refit=False)
    assert store.fits == before
    scored = M.positive_probability(model.transform(df)).select("id", "rf", "lr", "probability_1")
    assert scored.count() == 600
    row = result.orderBy("rank").first()
    assert row["mean_score"] > 0.6
    model.save(str(tmp_path / "stack"))
    again = M.positive_probability(stacking.StackModel.load(str(tmp_path / "stack")).transform(df)).select("id", "rf", "lr", "probability_1")
    assert sorted(again.collect()) == sorted(scored.collect())


def test_nested_scores_never_see_their_own_fold(spark):
    """A base that remembers its training ids scores 1 on them and 0 elsewhere."""
    from pyspark.ml import Estimator, Model

    class Memory(Model):
        def __init__(self, ids):
            super().__init__()
            self.ids = ids

        def _transform(self, d):
            p = F.col("id").isin(self.ids).cast("double")
            return d.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    class Learn(Estimator):
        def _fit(self, d):
            return Memory([r["id"] for r in d.select("id").collect()])

    df = S.stratified_folds(table(spark, 90), "id", "label", k=3, name="fold").cache()
    store = stacking.FoldStore(df, "id", "fold", "label", {"m": Learn})
    for outer in (None, *store.folds):
        rows = store.scores("m", {}, outer).collect()
        assert all(r["m"] == 0 for r in rows)
        assert len(rows) == df.where(F.lit(True) if outer is None else F.col("fold") != outer).count()
    assert store.fits == 6
    assert store.model("m", {}, [store.folds[0]]).ids and store.fits == 6
