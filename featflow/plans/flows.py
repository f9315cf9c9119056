"""End-to-end flows composed from the operators.

``fold_ensemble``: leakage screens (target correlation + name keywords) ->
class-mean imputation -> ordinal codes -> k stratified folds, each fold
model early-stopped on its held-out fold -> out-of-fold AUC per fold ->
four test ensembles (mean of folds, best fold, top-3 and top-5 by AUC).
Everything stays a DataFrame; the driver only holds fold AUCs and weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featflow.functions.features import leaky_columns
from featflow.operators import ensemble as N
from featflow.operators import models as M
from featflow.operators import sample as S
from featflow.operators.encode import Ordinal
from featflow.operators.evaluate import auc
from featflow.operators.impute import ClassMeanImpute, Impute
from featflow.operators.stats import leak_screen
from featflow.plans.training import cached


def fold_ensemble(train: DataFrame, test: DataFrame, key: str, label: str, categorical: Sequence[str],
                  numeric: Sequence[str], k: int = 7, seed: int = 42, max_iter: int = 50, max_depth: int = 5,
                  tops: Sequence[int] = (3, 5), report_top: int = 20) -> dict:
    # 1. leakage screens: strongly target-correlated numerics and leak-named columns are dropped
    suspects = [r["feature"] for r in leak_screen(train, list(numeric), label, top=None).collect()]
    dropped = sorted(set(suspects) | set(leaky_columns([c for c in train.columns if c not in (key, label)])))
    cat = [c for c in categorical if c not in dropped]
    num = [c for c in numeric if c not in dropped]
    # 2. class-mean imputation (train by class, test by the filled-train mean), codes for categoricals
    imp = ClassMeanImpute(num, label=label).fit(train)
    tr, te = imp.transform_labeled(train), imp.transform(test)
    fill = Impute(cat, strategy="label", value="Unknown").fit(tr)
    enc = Ordinal(cat, unknown=-1).fit(fill.transform(tr))
    feats = cat + num
    base = cached(M.assemble(enc.transform(fill.transform(tr)), feats))
    te = M.assemble(enc.transform(fill.transform(te)), feats)
    # 3. stratified folds; each fold model stops early on its own held-out fold
    tr = cached(S.stratified_folds(base, key, label, k=k, seed=seed, name="fold"))
    tr.count()
    base.unpersist()
    oof_parts, test_parts, report = [], [], []
    for f in range(k):
        data = tr.withColumn("_valid", F.col("fold") == f)
        m = M.gbt(max_iter=max_iter, max_depth=max_depth, seed=seed, validation_col="_valid", label=label).fit(data)
        ranked = sorted(M.importances(m, feats), key=lambda t: (-t[1], t[0]))
        report.append({"fold": f, "best_iteration": m.getNumTrees, "importances": ranked[:report_top]})
        oof_parts.append(M.positive_probability(m.transform(tr.where(F.col("fold") == f)))
                         .select(key, F.lit(f).alias("model"), F.col("probability_1").alias("score"), label))
        test_parts.append(M.positive_probability(m.transform(te))
                          .select(key, F.lit(f).alias("model"), F.col("probability_1").alias("score")))
    oof, tst = oof_parts[0], test_parts[0]
    for a, b in zip(oof_parts[1:], test_parts[1:]):
        oof, tst = oof.unionByName(a), tst.unionByName(b)
    oof = cached(oof)
    fold_auc = N.member_auc(oof)                              # one row per fold model
    overall = auc(oof).first()["auc"]
    aucs = {r["model"]: r["auc"] for r in fold_auc.collect()}
    tst = cached(tst)
    ens = {"mean": N.mean_vote(tst, key=key, keep=()),
           "best": N.blend(tst, N.best_weights(fold_auc), key=key, keep=())}
    for t in tops:
        if t <= k:
            ens[f"top{t}"] = N.blend(tst, N.topk_weights(fold_auc, t), key=key, keep=())
    for entry in report:
        entry["auc"] = aucs[entry["fold"]]
    return {"dropped": dropped, "fold_auc": aucs, "oof_auc": overall, "report": report, "ensembles": ens,
            "_cached": [tr, oof, tst]}


def release(result: dict) -> None:
    for df in result.get("_cached", []):
        df.unpersist()


def two_model_blend(train: DataFrame, test: DataFrame, key: str, label: str, categorical: Sequence[str],
                    numeric: Sequence[str], k: int = 5, seed: int = 42, ratio: float = 0.5,
                    makers: dict | None = None) -> dict:
    """SURVEY §3.2: E7 chain fitted on train -> stratified folds -> majority
    undersampled INSIDE each fold's training rows -> two models per fold ->
    OOF scores and test means -> blend weights from the simplex AUC search,
    per fold and over all OOF rows -> blended test scores + importances."""
    from featflow.plans.chain import fit_chain
    makers = makers or {"gbt": lambda: M.gbt(max_iter=30, max_depth=5, seed=seed, label=label),
                        "rf": lambda: M.forest(num_trees=50, max_depth=8, seed=seed, label=label)}
    chain = fit_chain(train, categorical, numeric)
    inter = chain.stages[-1].output_columns()
    feats = list(categorical) + list(numeric) + inter
    tr = cached(S.stratified_folds(M.assemble(chain.transform(train), feats), key, label, k=k, seed=seed, name="fold"))
    te = cached(M.assemble(chain.transform(test), feats))
    oof_parts, test_parts, importances = [], [], {}
    for f in range(k):
        fit_rows = S.undersample(tr.where(F.col("fold") != f), key, label, ratio=ratio, seed=seed)
        hold = tr.where(F.col("fold") == f)
        for name, make in makers.items():
            m = make().fit(fit_rows)
            importances.setdefault(name, []).append(dict(M.importances(m, feats)))
            oof_parts.append(M.positive_probability(m.transform(hold)).select(
                key, F.lit(f).alias("fold"), F.lit(name).alias("model"), F.col("probability_1").alias("score"), label))
            test_parts.append(M.positive_probability(m.transform(te)).select(
                key, F.lit(f).alias("fold"), F.lit(name).alias("model"), F.col("probability_1").alias("score")))
    oof, tst = oof_parts[0], test_parts[0]
    for a in oof_parts[1:]:
        oof = oof.unionByName(a)
    for b in test_parts[1:]:
        tst = tst.unionByName(b)
    oof, tst = cached(oof), cached(tst)
    members = list(makers)
    wide = cached(oof.groupBy(key, "fold", label).pivot("model", members).agg(F.first("score")))
    glob = N.blend_search(wide, members, label=label)
    per_fold = {f: N.blend_search(wide.where(F.col("fold") == f), members, label=label)["weights"] for f in range(k)}
    test_mean = tst.groupBy(key).pivot("model", members).agg(F.avg("score"))      # mean over fold models
    blended = test_mean.select(key, sum((F.col(m) * w for m, w in zip(members, glob["weights"])), F.lit(0.0))
                               .alias("probability"))
    imp = {name: {f: sum(d[f] for d in ds) / len(ds) for f in feats} for name, ds in importances.items()}
    return {"features": feats, "oof": oof, "global_weights": glob["weights"], "global_auc": glob["auc"],
            "fold_weights": per_fold, "submission": blended, "importances": imp,
            "_cached": [tr, te, oof, tst, wide]}


def stacked_search(train: DataFrame, test: DataFrame, key: str, label: str, categorical: Sequence[str],
                   numeric: Sequence[str], weights: dict | None = None, ratio: float = 0.5, k: int = 3,
                   n_iter: int = 3, seed: int = 42, makers: dict | None = None) -> dict:
    """SURVEY §3.3: fixed-procedure weights -> undersampling BEFORE the split
    (kept as in the source; it inflates the hold-out AUC) -> stratified 20 %
    hold-out -> k-fold OOF base scores -> robust-scaled logistic meta model
    whose C is chosen by a seeded random search on the hold-out -> hold-out
    AUC and submission scores."""
    from pyspark.ml import Pipeline

    from featflow.operators.scale import Robust
    from featflow.operators.weights import weight_fixed
    from featflow.plans.training import holdout_search, oof_scores
    makers = makers or {"gbt": lambda: M.gbt(max_iter=20, max_depth=4, seed=seed, label=label),
                        "rf": lambda: M.forest(num_trees=30, max_depth=8, seed=seed, label=label)}
    if weights:
        train, test = weight_fixed(train, weights), weight_fixed(test, weights)
    balanced = S.undersample(train, key, label, ratio=ratio, seed=seed)
    parts = S.stratified_holdout(balanced, key, label, 0.2, seed=seed)
    prep = Pipeline(stages=[Impute(list(categorical), strategy="label", value="Unknown"),
                            Impute(list(numeric), strategy="mean"), Ordinal(list(categorical), unknown=-1)])
    feats = list(categorical) + list(numeric)
    fit_rows = parts.where(F.col("part") == "fit")
    model = prep.fit(fit_rows)
    fr = cached(S.stratified_folds(M.assemble(model.transform(fit_rows), feats), key, label, k=k, seed=seed))
    hold = cached(M.assemble(model.transform(parts.where(F.col("part") == "holdout")), feats))
    te = M.assemble(model.transform(test), feats)
    members = list(makers)
    oof, _ = oof_scores(fr, key, "fold", makers, label)
    full = {name: make().fit(fr) for name, make in makers.items()}      # bases refit on all fitting rows

    def base_scores(df):
        out = df.select(key, *([label] if label in df.columns else []))
        for name, m in full.items():
            out = out.join(M.positive_probability(m.transform(df)).select(key, F.col("probability_1").alias(name)), key)
        return out

    wide = cached(oof.groupBy(key, label).pivot("model", members).agg(F.first("score")))
    scaler = Robust(members).fit(wide)
    meta_train = M.assemble(scaler.transform(wide), members)
    meta_hold = M.assemble(scaler.transform(base_scores(hold)), members)
    n = meta_train.count()
    grid = [{"C": c} for c in (0.01, 0.1, 1.0, 10.0, 100.0)]
    best, hold_auc, results = holdout_search(meta_train, meta_hold, lambda C: M.logistic(C=C, n_rows=n), grid,
                                             n_iter=n_iter, label=label, seed=seed)
    meta = M.logistic(C=best["C"], n_rows=n).fit(meta_train)
    sub = M.positive_probability(meta.transform(M.assemble(scaler.transform(base_scores(te)), members))) \
        .select(key, F.col("probability_1").alias("probability"))
    return {"best_params": best, "holdout_auc": hold_auc, "search": results, "submission": sub,
            "_cached": [fr, hold, wide]}
