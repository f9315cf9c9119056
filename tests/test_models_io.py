"""Models on the planted label, kNN against brute force, file I/O, streaming."""

import math
import random

import pytest
from pyspark.sql import functions as F

from featflow.operators import models as M
from featflow.operators.evaluate import auc
from featflow.operators.neighbors import knn
from featflow.sources import files as IO


@pytest.mark.parametrize("name", ["train_gbt", "train_lr", "train_adaboost"])
def test_models_learn_planted_signal(spark, sf_small, name):
    import __spark_entry__ as E
    from featflow.plans.fixtures import cases
    pred = E.queries()[name](spark, sf_small)
    lab = cases(spark, sf_small).select("case_id", "label")
    a = auc(pred.join(lab, "case_id"), score="probability").first()["auc"]
    assert a > 0.6


def test_rf_importances_normalised(spark, sf_small):
    import __spark_entry__ as E
    imp = E.queries()["train_rf"](spark, sf_small)
    for m in ("rf", "extra"):
        s = imp.where(F.col("model") == m).agg(F.sum("importance")).first()[0]
        assert abs(s - 1) < 1e-9


def test_knn_exact_against_brute_force(spark):
    rnd = random.Random(7)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = {(r.qid, r.nn_rank): r.nn_id for r in knn(df, "id", "v", 3, n_pivots=5).collect()}
    for qid, qv in pts:
        d = sorted((sum((a - b) ** 2 for a, b in zip(qv, v)), j) for j, v in pts if j != qid)
        for rank in range(3):
            assert got[(qid, rank + 1)] == d[rank][1]


def test_csv_charsets_and_sinks(spark, tmp_path):
    p = tmp_path / "k.csv"
    p.write_bytes("이름,값\n가,1\n나,2\n".encode("euc-kr"))
    df = IO.read_csv(spark, str(p), schema="`이름` string, `값` int", encoding="euc-kr")
    assert [tuple(r) for r in df.collect()] == [("가", 1), ("나", 2)]
    b = tmp_path / "b.csv"
    b.write_bytes("﻿ID,x\nA,1\n".encode("utf-8"))
    dfb = IO.read_csv(spark, str(b), encoding="utf-8-sig")
    assert dfb.columns[0] == "ID"
    out = tmp_path / "out"
    IO.write_csv(df, str(out))
    assert IO.read_csv(spark, str(out), schema="`이름` string, `값` int").count() == 2
    IO.write_feature_list(spark, ["b", "a"], str(tmp_path / "feats"))
    got = [r[0] for r in IO.read_csv(spark, str(tmp_path / "feats"), schema="selected_features string").collect()]
    assert got == ["b", "a"]
    assert IO.template_for("/x/test.csv") == "/x/sample_submission.csv"
    assert IO.dedupe_columns(["a", "b", "a"]) == ["a", "b"]


def test_stream_scoring_with_fitted_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline

    from featflow.operators.impute import Impute
    from featflow.operators.scale import MinMax
    from featflow.streaming import score_stream
    src = tmp_path / "in"
    batch = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    batch.write.parquet(str(src))
    model = Pipeline(stages=[Impute(["x"]), MinMax(["x"])]).fit(batch)
    stream = spark.readStream.schema("x double").parquet(str(src))
    q = score_stream(model, stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.x for r in spark.sql("SELECT x FROM scored").collect()) == [0.0, 0.5, 1.0]


def test_quick_leak_check_and_top_feature_retrain(spark, sf_small):
    from featflow.plans import training as T
    from featflow.queries.modeling import FEATURES, prepared
    tr, te = prepared(spark, sf_small)
    top = T.quick_leak_check(tr, "case_id", FEATURES, n=300, top=5, max_iter=5)
    assert len(top) == 5 and top[0][0] in ("totalprice", "band")       # the planted signal dominates
    raw_tr, raw_te = tr.drop("features"), te.drop("features")
    res = T.compare_top_features(raw_tr, raw_te, FEATURES, k=3,
                                 make=lambda: M.forest(num_trees=10, max_depth=5))
    assert len(res["top_features"]) == 3 and res["auc_all"] > 0.6 and res["auc_top"] > 0.6
    tr.unpersist()


def test_holdout_search_picks_best(spark, sf_small):
    from featflow.operators.sample import stratified_holdout
    from featflow.plans import training as T
    from featflow.queries.modeling import prepared
    tr, _ = prepared(spark, sf_small)
    parts = stratified_holdout(tr, "case_id", "label", 0.2)
    grid = [{"C": c} for c in (0.01, 1.0, 100.0)]
    best, best_auc, results = T.holdout_search(parts.where("part = 'fit'"), parts.where("part = 'holdout'"),
                                               lambda C: M.logistic(C=C, n_rows=1000), grid, n_iter=2)
    assert best_auc == max(a for _, a in results) and len(results) == 2
    tr.unpersist()


def test_select_by_type(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, d double")
    assert IO.select_by_type(df, numeric=True).columns == ["i", "d"]
    assert IO.select_by_type(df, numeric=False).columns == ["s"]


def test_queries_release_their_caches(spark, sf_small):
    """Queries that persist training tables must release them (the driver runs
    every query in one session)."""
    import __spark_entry__ as E
    jsc = spark.sparkContext._jsc
    before = jsc.getPersistentRDDs().size()
    for name in ("train_gbt", "train_lr", "train_adaboost", "stack_oof", "learning_curve", "blend_search",
                 "preprocess_chain"):
        E.queries()[name](spark, sf_small).collect()
        assert jsc.getPersistentRDDs().size() == before, name


def test_fold_ensemble_flow(spark, sf_small):
    from featflow.plans.fixtures import CATEGORICAL, NUMERIC, cases
    from featflow.plans.flows import fold_ensemble, release
    df = cases(spark, sf_small)
    tr, te = df.where("split = 'train'").drop("split"), df.where("split = 'test'").drop("split", "label")
    res = fold_ensemble(tr, te, "case_id", "label", CATEGORICAL, NUMERIC, k=3, max_iter=5, max_depth=3, tops=(2,))
    assert set(res["fold_auc"]) == {0, 1, 2} and res["oof_auc"] > 0.6
    assert [e["fold"] for e in res["report"]] == [0, 1, 2]
    assert all(1 <= e["best_iteration"] <= 5 and e["importances"] and e["auc"] > 0.5 for e in res["report"])
    n_test = te.count()
    for name, ens in res["ensembles"].items():
        assert ens.count() == n_test, name
    lab = df.select("case_id", "label")
    top = res["ensembles"]["top2"].join(lab, "case_id")
    assert auc(top).first()["auc"] > 0.6
    release(res)


def test_two_model_blend_flow(spark, sf_small):
    from featflow.plans.fixtures import CATEGORICAL, NUMERIC, cases
    from featflow.plans.flows import release, two_model_blend
    df = cases(spark, sf_small)
    tr, te = df.where("split = 'train'"), df.where("split = 'test'").drop("label")
    makers = {"gbt": lambda: M.gbt(max_iter=5, max_depth=3), "rf": lambda: M.forest(num_trees=8, max_depth=5)}
    res = two_model_blend(tr, te, "case_id", "label", CATEGORICAL, NUMERIC, k=3, makers=makers)
    assert abs(sum(res["global_weights"]) - 1) < 1e-12 and res["global_auc"] > 0.6
    assert len(res["fold_weights"]) == 3
    sub = res["submission"]
    assert sub.count() == te.count()
    assert auc(sub.join(df.select("case_id", "label"), "case_id"), score="probability").first()["auc"] > 0.6
    assert abs(sum(res["importances"]["rf"].values()) - 1) < 1e-9
    release(res)


def test_stacked_search_flow(spark, sf_small):
    from featflow.plans.fixtures import CATEGORICAL, NUMERIC, cases
    from featflow.plans.flows import release, stacked_search
    df = cases(spark, sf_small)
    tr, te = df.where("split = 'train'"), df.where("split = 'test'").drop("label")
    makers = {"gbt": lambda: M.gbt(max_iter=5, max_depth=3), "rf": lambda: M.forest(num_trees=8, max_depth=5)}
    res = stacked_search(tr, te, "case_id", "label", CATEGORICAL, NUMERIC, weights={"totalprice": 2.0},
                         makers=makers, n_iter=2)
    assert res["holdout_auc"] > 0.6 and len(res["search"]) == 2
    sub = res["submission"]
    assert sub.count() == te.count()
    assert auc(sub.join(df.select("case_id", "label"), "case_id"), score="probability").first()["auc"] > 0.6
    release(res)


def test_adaboost_checkpoints_and_saves(spark, sf_small, tmp_path):
    from featflow.queries.modeling import FEATURES, prepared
    tr, te = prepared(spark, sf_small)
    plain = M.adaboost(tr, FEATURES, rounds=5)
    often = M.adaboost(tr, FEATURES, rounds=5, checkpoint_every=2)
    assert plain.fitted == often.fitted and 1 <= len(plain.fitted["stumps"]) <= 5
    lr = M.logistic(C=1.0, n_rows=100).fit(tr)
    assert IO.save_best({"lr": lr, "ada": plain}, {"lr": 0.6, "ada": 0.7}, str(tmp_path / "best")) == "ada"
    again = M.AdaBoostModel.load(str(tmp_path / "best"))
    scores = lambda m: sorted(r.probability_1 for r in m.transform(te).select("probability_1").collect())
    assert scores(again) == scores(plain)
    with pytest.raises(ValueError):
        M.logistic(C=1.0)
    tr.unpersist()


def test_search_table_and_meta_models(spark, sf_small):
    from pyspark.ml.classification import LogisticRegression

    from featflow.operators.sample import stratified_folds
    from featflow.plans import training as T
    from featflow.queries.modeling import prepared
    base, te = prepared(spark, sf_small)
    tr = T.cached(stratified_folds(base, "case_id", "label", k=2))
    make = {n: (lambda r=r: LogisticRegression(labelCol="label", regParam=r, maxIter=20)) for n, r in (("plain", 0.0), ("ridge", 0.5))}
    table = T.search_table(tr, make, "fold")
    rows = table.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0].mean_score >= rows[1].mean_score > 0.5
    assert abs(rows[0].mean_score - (rows[0].split0_score + rows[0].split1_score) / 2) < 1e-12
    assert all(r.mean_fit_seconds > 0 for r in rows)
    acc = T.search_table(tr, make, "fold", metric=T.accuracy()).collect()
    assert all(0.5 < r.mean_score <= 1 for r in acc)
    oof, tst = T.oof_scores(tr, "case_id", "fold", make, test=te)
    n = te.count()
    forest = lambda weight_col: M.forest(num_trees=5, max_depth=3, weight_col=weight_col)
    for kw in ({"balanced": True}, {"balanced": True, "meta": forest}):
        out = T.stack(oof, tst, list(make), **kw)
        assert out.count() == n and out.where("probability is null").count() == 0
    base.unpersist()
    tr.unpersist()
