"""Properties from SURVEY §5: ranges, fold balance, AUC symmetry, weights,
fit-on-train isolation, exact AUC against a brute-force pair count."""

import random

from pyspark.sql import functions as F

from featflow.operators import ensemble as N
from featflow.operators import evaluate as E
from featflow.operators import sample as S
from featflow.operators.scale import MinMax
from featflow.plans.fixtures import cases, scores


def test_minmax_in_unit_interval_on_train(spark, sf_small):
    df = cases(spark, sf_small).where("split = 'train'")
    out = MinMax(["totalprice", "acctbal"]).fit(df).transform(df)
    r = out.agg(F.min("totalprice"), F.max("totalprice"), F.min("acctbal"), F.max("acctbal")).first()
    assert r[0] == 0.0 and r[1] == 1.0 and r[2] == 0.0 and r[3] == 1.0


def test_folds_disjoint_and_stratified(spark, sf_small):
    df = cases(spark, sf_small).select("case_id", "label")
    f = S.stratified_folds(df, "case_id", "label", k=5)
    assert f.count() == df.count() and f.select("case_id").distinct().count() == df.count()
    per = f.groupBy("label", "fold").count().collect()
    for lab in (0, 1):
        ns = [r["count"] for r in per if r["label"] == lab]
        assert max(ns) - min(ns) <= 1


def test_auc_symmetry_and_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, round(rnd.random(), 1), rnd.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, score double, label int")
    a = E.auc(df).first()["auc"]
    flipped = E.auc(df.withColumn("score", 1 - F.col("score"))).first()["auc"]
    assert abs(a + flipped - 1) < 1e-12
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a - brute) < 1e-12


def test_auc_by_group_matches_separate(spark, sf_small):
    sc = scores(spark, sf_small)
    per = {r["model"]: r["auc"] for r in E.auc(sc, ["model"]).collect()}
    one = E.auc(sc.where("model = 'a'")).first()["auc"]
    assert abs(per["a"] - one) < 1e-12


def test_weights_sum_to_one(spark, sf_small):
    aucs = N.member_auc(scores(spark, sf_small))
    for w in (N.topk_weights(aucs, 2), N.bonus_weights(aucs), N.proportional_weights(aucs)):
        assert abs(w.agg(F.sum("w")).first()[0] - 1.0) < 1e-12


def test_fit_on_train_unaffected_by_test_rows(spark, sf_small):
    df = cases(spark, sf_small)
    train = df.where("split = 'train'")
    m1 = MinMax(["totalprice"]).fit(train)
    extreme = train.limit(1).withColumn("totalprice", F.lit(1e12)).withColumn("split", F.lit("test"))
    m2 = MinMax(["totalprice"]).fit(df.unionByName(extreme).where("split = 'train'"))
    assert m1.fitted == m2.fitted


def test_undersample_ratio(spark, sf_small):
    df = cases(spark, sf_small).select("case_id", "label")
    c = S.class_counts(df)
    out = S.class_counts(S.undersample(df, "case_id", "label", 0.5))
    n_min = min(c.values())
    assert sorted(out.values()) == sorted([n_min, min(max(c.values()), 2 * n_min)])


def test_youden_first_on_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, label int")
    y = E.youden(E.roc_curve(df)).first()
    assert y["threshold"] == 0.9 and abs(y["j"] - 0.5) < 1e-12


def test_blend_search_prefers_signal(spark, sf_small):
    from featflow.queries.ensembles import _wide
    res = N.blend_search(_wide(scores(spark, sf_small)), ["a", "b", "c"], units=10, refine=2, radius=2)
    assert abs(sum(res["weights"]) - 1) < 1e-12
    assert res["auc"] >= res["coarse_auc"] - 1e-12
