"""boosting holds rows in blocks and makes gradients once a tree."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featflow.operators import boosting as B


def table(spark, n=900):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=n), rng.integers(0, 6, n), rng.random(n)]
    x[rng.random(n) < 0.1, 0] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-np.nan_to_num(x[:, 0])))).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>, label int, valid boolean").withColumn("features", array_to_vector("x")).repartition(3).cache()


def test_rows_are_blocks_and_gradients_are_made_once_a_tree(spark, monkeypatch):
    df = table(spark)
    spec = B.fit_bins(df, "features", [1], 16)
    data = df.select("x", F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"), F.col("valid").alias("held"), F.lit(0.0).alias("u"))
    rows = data.mapInArrow(partial(B._bin_rows, spec=spec, bins=16, start=0.0), B._ROWS)
    assert rows.count() <= 6                                    # three partitions, rows held or not
    made = []
    real = B.gradients
    monkeypatch.setattr(B, "gradients", lambda rows, done, sample=(1.0, 0.0): made.append(len(done)) or real(rows, done, sample))
    model = B.BoostedTrees(rounds=5, block=3, bins=16, max_leaves=6, min_child_rows=5, categorical=[1], validation="valid").fit(df)
    assert made == [0, 1, 2, 0, 1] and len(model.history) == 5


def test_a_level_is_one_step_of_all_rows():
    tree = B.as_arrays({"feature": [1, -1, 0, -1, -1], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1],
                        "bins_left": [[0, 3], [], [1, 2], [], []], "value": [0.0, 1.0, 0.0, 2.0, 3.0]}, 4)
    assert tree["depth"] == 2
    b = np.array([[i, j] for i in range(4) for j in range(4)], np.uint8)
    want = [1 if j in (0, 3) else 3 if i in (1, 2) else 4 for i, j in b]
    assert B.route(b, tree).tolist() == want == B.route(np.asfortranarray(b), tree).tolist()
    assert B.margins(b, [tree, tree]).tolist() == [2 * tree["value"][k] for k in want]
