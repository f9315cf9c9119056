"""Operators on tiny literal frames: NULL, constant, unseen, ties, one row, no row."""

import math

import pytest
from pyspark.sql import functions as F

from featflow.operators.encode import OneHot, Ordinal, Target, assert_no_unseen, fit_levels, keep_levels
from featflow.operators.impute import ClassMeanImpute, Impute
from featflow.operators.scale import Fence, MinMax, Robust, Standard, YeoJohnson


@pytest.fixture()
def small(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, None, 5.0, 0), (2, "b", 2.0, None, 5.0, 1), (3, "a", None, None, 5.0, 1),
         (4, None, 4.0, None, 5.0, 0)],
        "id int, cat string, x double, allnull double, const double, label int")


def test_impute_mean_median_mode(small):
    m = Impute(["x", "allnull"], strategy="mean").fit(small)
    xs = [r["x"] for r in m.transform(small).orderBy("id").collect()]
    assert xs == [1.0, 2.0, 7.0 / 3, 4.0]
    assert all(r["allnull"] is None for r in m.transform(small).collect())  # nothing to fill with
    med = Impute(["x"], strategy="median").fit(small)
    assert med.fitted["values"]["x"] == 2.0
    mode = Impute(["cat"], strategy="mode").fit(small)
    assert mode.fitted["values"]["cat"] == "a"


def test_mode_ties_lowest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "c string")
    assert Impute(["c"], strategy="mode").fit(df).fitted["values"]["c"] == "a"


def test_impute_by_group(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", None), ("s", 10.0), ("s", None)], "g string, x double")
    out = Impute(["x"], strategy="mean", by="g").fit(df).transform(df).collect()
    assert sorted((r.g, r.x) for r in out) == [("s", 10.0), ("s", 10.0), ("t", 1.0), ("t", 1.0)]


def test_class_mean_impute(spark):
    tr = spark.createDataFrame([(0, 1.0), (0, None), (1, 5.0), (1, None)], "label int, x double")
    m = ClassMeanImpute(["x"]).fit(tr)
    filled = sorted(r.x for r in m.transform_labeled(tr).collect())
    assert filled == [1.0, 1.0, 5.0, 5.0]
    assert m.fitted["overall"]["x"] == 3.0          # mean of the filled training column
    te = spark.createDataFrame([(None,)], "x double")
    assert m.transform(te).first().x == 3.0


def test_ordinal_unseen_and_missing(small, spark):
    m = Ordinal(["cat"], unknown=-1, missing=None).fit(small)
    assert m.fitted["codes"]["cat"] == {"a": 0, "b": 1}
    new = spark.createDataFrame([("a",), ("z",), (None,)], "cat string")
    assert [r.cat for r in m.transform(new).collect()] == [0, -1, None]
    codes = Ordinal(["cat"], unknown=-1, missing=-1).fit(small).transform(new)
    assert [r.cat for r in codes.collect()] == [0, -1, -1]
    with pytest.raises(ValueError):
        assert_no_unseen(m, new)
    assert_no_unseen(m, small)
    back = m.inverse(m.transform(small)).orderBy("id").collect()
    assert [r.cat for r in back] == ["a", "b", "a", None]


def test_ordinal_large_level_table_path(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    m = Ordinal(["k"], max_levels=10).fit(df)      # forces the written-table join path
    assert "path" in m.fitted
    out = {r.k for r in m.transform(df).collect()}
    assert out == set(range(50))


def test_onehot_unseen_all_zero(small, spark):
    m = OneHot(["cat"], dummy_na=True).fit(small)
    assert m.output_columns() == ["cat_a", "cat_b", "cat_nan"]
    r = m.transform(spark.createDataFrame([("z",), (None,)], "cat string")).collect()
    assert [(x.cat_a, x.cat_b, x.cat_nan) for x in r] == [(0, 0, 0), (0, 0, 1)]


def test_target_encoder_prior_and_smoothing(small, spark):
    m = Target(["cat"]).fit(small)
    prior = 0.5
    assert m.fitted["prior"] == prior
    s = 1 / (1 + math.exp(-(2 - 20) / 10))
    assert abs(m.fitted["values"]["cat"]["a"] - (prior * (1 - s) + 0.5 * s)) < 1e-12
    new = m.transform(spark.createDataFrame([("z",), (None,)], "cat string")).collect()
    assert [r.cat for r in new] == [prior, prior]


def test_scalers_constant_and_nulls(small):
    mm = MinMax(["x", "const"]).fit(small).transform(small).orderBy("id").collect()
    assert [r.x for r in mm] == [0.0, 1 / 3, None, 1.0]
    assert {r.const for r in mm} == {0.0}
    st = Standard(["const"]).fit(small).transform(small).collect()
    assert {r.const for r in st} == {0.0}
    rb = Robust(["const"]).fit(small).transform(small).collect()
    assert {r.const for r in rb} == {0.0}


def test_fence_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    m = Fence(["x"], 0.25, 0.75, 1.5).fit(df)
    lo, hi = m.fitted["x"]
    assert (lo, hi) == (2 - 1.5 * 2, 4 + 1.5 * 2)
    assert max(r.x for r in m.transform(df).collect()) == 7.0


def test_yeo_johnson_standardised(spark):
    df = spark.createDataFrame([(float(v),) for v in [0.1, 0.5, 1, 2, 5, 10, 50, 100]], "x double")
    m = YeoJohnson(["x"]).fit(df)
    lam = m.fitted["x"][0]
    assert -3 <= lam <= 3
    vals = [r.x for r in m.transform(df).collect()]
    mean = sum(vals) / len(vals)
    sd = math.sqrt(sum((v - mean) ** 2 for v in vals) / len(vals))
    assert abs(mean) < 1e-9 and abs(sd - 1) < 1e-9


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "x double, c string")
    assert Impute(["x"], strategy="mean").fit(empty).fitted["values"]["x"] is None
    assert Ordinal(["c"]).fit(empty).fitted["codes"]["c"] == {}
    one = spark.createDataFrame([(3.0, "q")], "x double, c string")
    assert MinMax(["x"]).fit(one).transform(one).first().x == 0.0
    rows, path = fit_levels(one, ["c"])
    assert path is None and len(rows) == 1


def test_stage_persistence(spark, small, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    p = Pipeline(stages=[Impute(["x"], strategy="mean"), Ordinal(["cat"]), MinMax(["x"])]).fit(small)
    path = str(tmp_path / "m")
    p.write().overwrite().save(path)
    q = PipelineModel.load(path)
    a = p.transform(small).orderBy("id").collect()
    b = q.transform(small).orderBy("id").collect()
    assert a == b


def test_exact_quantiles_distributed_matches_numpy(spark):
    import random

    import numpy as np

    from featflow.operators.quantiles import exact_quantiles
    rnd = random.Random(5)
    vals = [(rnd.random() * 10, float(rnd.randint(0, 3))) for _ in range(3000)]
    df = spark.createDataFrame(vals, "a double, b double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for kw in ({}, {"accuracy": 50, "max_collect": 40}):      # second: forces histogram narrowing
        got = exact_quantiles(df, ["a", "b"], ps, **kw)
        for j, c in enumerate("ab"):
            exp = np.quantile(np.array([v[j] for v in vals]), ps)
            assert max(abs(g - e) for g, e in zip(got[c], exp)) == 0.0


def test_target_encoder_table_path_equals_map_path(spark):
    rows = [(f"k{i % 37}", (i * 7) % 3 == 0 and 1 or 0) for i in range(400)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, label int")
    new = spark.createDataFrame([("k1",), ("k36",), ("zz",), (None,)], "k string")
    for mode in ("sigmoid", "additive"):
        small = Target(["k"], mode=mode).fit(df)
        big = Target(["k"], mode=mode, max_levels=5).fit(df)      # forces the written-table join path
        assert "path" in big.fitted and "values" in small.fitted
        assert abs(big.fitted["prior"] - small.fitted["prior"]) < 1e-12
        a = [r.k for r in small.transform(new).collect()]
        b = {r.k for r in big.transform(new).collect()}
        assert {round(v, 12) for v in a} == {round(v, 12) for v in b}


def test_onehot_refuses_unbounded_levels(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError):
        OneHot(["k"], max_levels=10).fit(df)


def test_large_level_table_inverse_strict_and_kept_copy(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 37}",) for i in range(200)] + [(None,)], "k string")
    new = spark.createDataFrame([("k1",), ("k36",), ("zz",), (None,)], "k string")
    carried, written = Ordinal(["k"]).fit(df), Ordinal(["k"], max_levels=5).fit(df)
    assert "path" in written.fitted and len(carried.levels()["k"]) == 37
    key = lambda m: sorted(tuple(r) for r in m.level_table().collect())
    assert key(carried) == key(written)
    for m in (carried, written):
        assert sorted((r.k for r in m.transform(new).collect()), key=str) == sorted([1, 30, -1, None], key=str)
        back = [r.k for r in m.inverse(m.transform(new)).collect()]
        assert sorted(map(str, back)) == ["None", "None", "k1", "k36"]
        assert_no_unseen(m, df)
        with pytest.raises(ValueError):
            assert_no_unseen(m, new)
    with pytest.raises(ValueError):
        written.levels()
    kept = keep_levels(written, str(tmp_path / "levels"))
    assert str(tmp_path) in kept.fitted["path"] and key(kept) == key(written)


def test_many_carried_levels_use_a_bounded_join(spark):
    rows = [(f"k{i:04d}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, label int")
    m = Ordinal(["k"]).fit(df)
    assert {r.k for r in m.transform(df).collect()} == set(range(300))
    assert {r.k for r in m.inverse(m.transform(df)).collect()} == {k for k, _ in rows}
    t = Target(["k"]).fit(df)
    assert {round(r.k, 12) for r in t.transform(df).collect()} == {round(v, 12) for v in t.fitted["values"]["k"].values()}


@pytest.mark.parametrize("power", [8.0, 25.0, -12.0])
def test_yeo_johnson_widens_its_bracket(spark, power):
    """Values whose transform of the given power is evenly spread around."""
    spread = [3 + i / 40 for i in range(-40, 41)]
    xs = [(v ** (1 / power) if power > 0 else (v / 10) ** (1 / power)) - 1 for v in spread]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    lam = YeoJohnson(["x"]).fit(df).fitted["x"][0]

    def likelihood(lam):
        t = [((1 + x) ** lam - 1) / lam for x in xs]
        mean = sum(t) / len(t)
        return -len(t) / 2 * math.log(sum((v - mean) ** 2 for v in t) / len(t)) + (lam - 1) * sum(math.log1p(x) for x in xs)

    assert abs(lam) > 3.2
    assert likelihood(lam) >= max(likelihood(lam - 0.002), likelihood(lam + 0.002))


def test_class_mean_boolean_and_null_labels(spark):
    df = spark.createDataFrame([(True, 4.0), (True, None), (False, 1.0), (False, None), (None, None)], "label boolean, x double")
    m = ClassMeanImpute(["x"]).fit(df)
    got = sorted((str(r.label), r.x) for r in m.transform_labeled(df).collect())
    assert got == [("False", 1.0), ("False", 1.0), ("None", 2.5), ("True", 4.0), ("True", 4.0)]
    for strategy in ("mean", "median"):
        out = Impute(["x"], strategy=strategy, by="label").fit(df).transform(df).where("label is not null")
        assert sorted(r.x for r in out.collect()) == [1.0, 1.0, 4.0, 4.0]


def test_weights_on_numeric_text_and_rows_without_a_procedure(spark):
    from featflow.operators.weights import WeightTable, weight_by_key
    t = WeightTable([{"feature": "x", "A": 2, "Unknown": 5}, {"feature": "s", "A": 3, "Unknown": 4}])
    df = spark.createDataFrame([("A", 1.0, "2.5"), ("A", 1.0, "text"), (None, 1.0, "2.5"), ("Z", None, None)],
                               "proc string, x double, s string")
    rows = lambda **kw: sorted((tuple(r) for r in weight_by_key(df, t, "proc", **kw).collect()), key=str)
    assert rows() == sorted([("A", 2.0, "7.5"), ("A", 2.0, "text"), (None, 5.0, "10.0"), ("Z", None, None)], key=str)
    assert (None, 1.0, "2.5") in rows(leave_null_key=True)


def test_low_cardinality_numerics(spark):
    from featflow.operators.stats import recast_low_cardinality
    df = spark.range(100).selectExpr("id % 9 as few", "id as many", "id % 10 as ten", "cast(null as int) as none")
    assert recast_low_cardinality(df, ["few", "many", "ten", "none"]) == ["few", "none"]
