"""Tree queries beyond pyspark.ml (J1, J2, J4) and the stacked search.

Trained models are rows-only checks; what a tree is grown from (ordered target
statistics, the gradient histogram of a root) has SQL.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featflow.functions.parse import round6
from featflow.operators import boosting as B
from featflow.operators import models as M
from featflow.operators import sample as S
from featflow.operators.extra_trees import ExtraTrees
from featflow.operators.ordered import ordered_target
from featflow.operators.scale import Standard
from featflow.plans import stacking
from featflow.plans import training as T
from featflow.plans.fixtures import CATEGORICAL, KEY, LABEL, SPLIT, cases
from featflow.queries import query
from featflow.queries.modeling import FEATURES, prepared
from featflow.queries.sql import r6, with_cases

_ORDERED = ["priority", "nation", "band"]
_ORDERED_SQL = ", ".join(
    r6(f"(coalesce(sum(label) OVER ({w}), 0) + 1.0 * p) / (count(*) OVER ({w}) + 1.0)") + f" AS {c}_ots"
    for c in _ORDERED for w in [f"PARTITION BY {c} ORDER BY md5(concat_ws('|', '42', case_id)), case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"])


@query("encode_ordered", with_cases(f"SELECT case_id, {_ORDERED_SQL} FROM cases, (SELECT avg(label) AS p FROM cases WHERE split = 'train') WHERE split = 'train'"))
def encode_ordered(spark, sf_dir):
    """Ordered target statistics of the training rows in the seeded order."""
    train = cases(spark, sf_dir).where(F.col(SPLIT) == "train").select(KEY, LABEL, *_ORDERED)
    out = ordered_target(train, _ORDERED, KEY, LABEL)
    return out.select(KEY, *[round6(f"{c}_ots").alias(f"{c}_ots") for c in _ORDERED])


_LEVELS = ["status", "segment", "nation", "region"]


@query("boost_histogram", with_cases(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level, {r6('sum(p - label)')} AS gradient, {r6('sum(p * (1 - p))')} AS hessian, count(*) AS n_rows "
                       f"FROM cases, (SELECT avg(label) AS p FROM cases WHERE split = 'train') WHERE split = 'train' GROUP BY {c}" for c in _LEVELS)))
def boost_histogram(spark, sf_dir):
    """Gradient, hessian and rows by level at the root of the first tree."""
    from featflow.operators.encode import Ordinal
    train = cases(spark, sf_dir).where(F.col(SPLIT) == "train").select(LABEL, *_LEVELS)
    codes = Ordinal(_LEVELS, unknown=-1).fit(train)
    coded = M.assemble(codes.transform(train), _LEVELS)
    spec = B.fit_bins(coded, "features", range(len(_LEVELS)), 64)
    p = train.agg(F.avg(LABEL).alias("p")).first()["p"]
    data = coded.select(vector_to_array("features").alias("x"), F.col(LABEL).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("held"), F.lit(0.0).alias("u"))
    rows = data.mapInArrow(partial(B._bin_rows, spec=spec, bins=64, start=math.log(p / (1 - p))), B._ROWS)
    leaf = B.as_arrays({"feature": [-1], "left": [-1], "right": [-1], "bins_left": [[]], "value": [0.0]}, 64)
    sums = B.histograms(rows, [], leaf, [0], len(_LEVELS), 64)[0]
    found = [(i, float(code), *map(float, sums[i, b])) for i, s in enumerate(spec) for b, code in enumerate(s["levels"])]
    table = spark.createDataFrame(found, "f int, code double, gradient double, hessian double, n double")
    names = codes.level_table().select("column", "value", F.col("code").cast("double").alias("code"))
    feature = F.element_at(F.array(*map(F.lit, _LEVELS)), F.col("f") + 1)
    return (table.withColumn("column", feature).join(F.broadcast(names), ["column", "code"])         # at most features x bins rows
                 .select(F.col("column").alias("feature"), F.col("value").alias("level"), round6("gradient").alias("gradient"),
                         round6("hessian").alias("hessian"), F.col("n").cast("bigint").alias("n_rows")))


@query("train_boosted")
def train_boosted(spark, sf_dir):
    """Second-order boosting, categorical splits, leaf-wise growth with
    L1/L2 penalties, stopped by patience on the AUC of a stratified 20 % part."""
    base, te = prepared(spark, sf_dir)
    tr = T.cached(S.stratified_holdout(base, KEY, LABEL, 0.2, name="part").withColumn("is_valid", F.col("part") == "holdout"))
    tr.count()
    base.unpersist()
    model = B.BoostedTrees(rounds=30, rate=0.2, max_leaves=15, max_depth=5, l1=0.1, l2=3.0, validation="is_valid", patience=8,
                           categorical=list(range(len(CATEGORICAL))), block=8).fit(tr)
    tr.unpersist()
    return M.positive_probability(model.transform(te)).select(KEY, F.col("probability_1").alias("probability"))


@query("train_extra")
def train_extra(spark, sf_dir):
    """Extremely randomised trees; test rows scored lazily."""
    tr, te = prepared(spark, sf_dir)
    model = ExtraTrees(trees=30, max_depth=8, min_rows_leaf=5).fit(tr)
    tr.unpersist()
    return M.positive_probability(model.transform(te)).select(KEY, F.col("probability_1").alias("probability"))


@query("stack_search")
def stack_search(spark, sf_dir):
    """Five draws of base and meta parameters of a stack, three
    outer folds; the nested scores of a base are made once for its parameters."""
    base, _ = prepared(spark, sf_dir, extra_stages=[Standard(FEATURES)])
    tr = T.cached(S.stratified_folds(base, KEY, LABEL, k=3, name="fold"))
    n = tr.count()
    base.unpersist()
    store = stacking.FoldStore(tr, KEY, "fold", LABEL, {"lr": lambda C: M.logistic(C=C, n_rows=n, max_iter=30),
                                                        "rf": lambda depth: M.forest(num_trees=10, max_depth=depth)})
    table, _, _ = stacking.joint_search(store, {"lr__C": [0.01, 1.0], "rf__depth": [4, 6], "meta__C": [0.1, 1.0, 10.0]}, n_iter=5, refit=False, balanced=True)
    tr.unpersist()
    return table
