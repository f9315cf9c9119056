"""No operator loses rows: null, boolean and double labels, tiny and repeated
neighbour tables."""

import pytest
from pyspark.sql import functions as F

from featflow.operators import neighbors as NB
from featflow.operators import sample as S
from featflow.operators.evaluate import auc


@pytest.fixture(scope="module", params=["null", "boolean", "double"])
def labelled(spark, request):
    d = spark.range(400).withColumnRenamed("id", "key")
    y = {"null": F.when(F.col("key") % 10 > 0, (F.col("key") % 4 == 0).cast("int")), "boolean": F.col("key") % 4 == 0,
         "double": (F.col("key") % 4 == 0).cast("double")}[request.param]
    return d.withColumn("label", y)


def test_folds_and_holdouts_keep_every_row(labelled):
    folds = S.stratified_folds(labelled, "key", "label", k=5)
    assert folds.count() == 400 and folds.where("fold is null").count() == 0
    part = S.stratified_holdout(labelled, "key", "label", 0.2)
    assert part.count() == 400 and 78 <= part.where("part = 'holdout'").count() <= 82


def test_undersampling_and_weights(labelled):
    kept = S.undersample(labelled, "key", "label", ratio=1.0)
    counts = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
    sizes = {v for k, v in counts.items() if k is not None}
    assert len(sizes) == 1 and counts.get(None, 40) == 40
    assert S.undersample_union(labelled, "key", "label").count() == kept.count()
    weights = {r["label"]: r["weight"] for r in S.class_weights(labelled, "label", "scale_pos").distinct().select("label", "weight").distinct().collect()}
    assert [w for k, w in weights.items() if k in (1, True)][0] > 1.0 and [w for k, w in weights.items() if k is not None and not k] == [1.0]


@pytest.mark.parametrize("n,distinct", [(1, 1), (2, 2), (10, 10), (16, 16), (30, 1), (40, 3)])
def test_knn_answers_every_query(spark, n, distinct):
    rows = [(i, [float(i % distinct), 1.0, float((i % distinct) ** 2)]) for i in range(n)]
    got = NB.knn(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 2).collect()
    assert len(got) == n * min(2, n - 1)
    for r in got:
        near = sorted((sum((a - b) ** 2 for a, b in zip(rows[r.qid][1], v)), i) for i, v in rows if i != r.qid)
        assert (r.sqdist, r.nn_id) == near[r.nn_rank - 1]


def test_smote_with_a_small_minority(spark):
    rows = [(i, [float(i), 1.0], int(i < 4)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    assert NB.smote(df, "id", "v", "y", k=5).count() == 22
    with pytest.raises(ValueError):
        NB.smote(df.where("id = 0 or id > 3"), "id", "v", "y")


def test_auc_keeps_the_null_group(spark):
    rows = [(g, float(i % 7), i % 2) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    assert {r["g"]: r["n_pos"] for r in auc(df, by=["g"]).collect()} == {"a": 20, None: 20}


def test_every_suspect_is_screened(spark):
    from featflow.operators.stats import leak_screen
    df = spark.range(50).select((F.col("id") % 2).cast("int").alias("label"), *[((F.col("id") % 2) * (i + 1) + 0.0).alias(f"x{i}") for i in range(11)])
    cols = [f"x{i}" for i in range(11)]
    assert leak_screen(df, cols).count() == 10 and leak_screen(df, cols, top=None).count() == 11


def test_yeo_johnson_ignores_nan(spark):
    from featflow.operators.scale import YeoJohnson
    rows = [(float(i) ** 1.5,) for i in range(60)]
    clean, dirty = (YeoJohnson(["x"]).fit(spark.createDataFrame(r, "x double")) for r in (rows, rows + [(float("nan"),)]))
    a, b = (m.transform(spark.createDataFrame(rows, "x double")).collect() for m in (clean, dirty))
    assert all(abs(p.x - q.x) < 1e-9 for p, q in zip(sorted(a), sorted(b)))
