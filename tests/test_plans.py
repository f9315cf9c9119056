"""Plan regressions for the scale properties the design relies on."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from featflow.operators.ranking import hash_rank
from featflow.operators.weights import WeightTable, weight_by_key


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_pruned_to_the_scan(spark, sf_small):
    plan = _plan(E.queries()["rate_by_group"](spark, sf_small))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    assert "l_quantity" not in plan          # unused left join to the line aggregate is eliminated


def test_hash_rank_has_no_single_partition_window_over_rows(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    r = hash_rank(df, "id", by=["g"])
    plan = _plan(r)
    # the only unpartitioned exchange may feed the small per-bucket counts table
    assert r.count() == 5000 and r.select("g", "rank").distinct().count() == 5000
    assert "hashpartitioning(g" in plan


def test_rowwise_weights_rules_and_broadcast(spark):
    t = WeightTable([{"feature": "x", "A": 2, "IUI": 3, "Unknown": 5},
                     {"feature": "DI_x", "A": 2, "IUI": 3, "Unknown": 5},
                     {"feature": "absent", "A": 9, "IUI": 9, "Unknown": 9}])
    df = spark.createDataFrame([("A", 1.0, 1.0, "s"), ("IUI", 1.0, 1.0, "s"), ("Z", 1.0, 1.0, "s")],
                               "proc string, x double, DI_x double, s string")
    out = weight_by_key(df, t, "proc", fallback="Unknown", zero_marker="DI", zero_unless="IUI")
    got = {r.proc: (r.x, r.DI_x) for r in out.collect()}
    assert got == {"A": (2.0, 0.0), "IUI": (3.0, 3.0), "Z": (5.0, 0.0)}
    assert t.unmatched(df.columns) == ["absent"]
    assert "BroadcastHashJoin" in _plan(out)


def test_jobs_per_fit(spark, sf_small):
    """BASELINE target: one aggregate per statistic-based fit; Yeo-Johnson and
    exact quantiles at most three passes. AQE runs each shuffled aggregate
    as a map-stage job plus a result job, hence 2 jobs per pass."""
    from featflow.operators.encode import Ordinal, Target
    from featflow.operators.impute import ClassMeanImpute, Impute
    from featflow.operators.scale import Fence, MinMax, Robust, Standard, YeoJohnson
    from featflow.plans.fixtures import CATEGORICAL, NUMERIC, cases
    df = cases(spark, sf_small).cache()
    df.count()
    sc = spark.sparkContext
    limits = {"minmax": (MinMax(NUMERIC), 2), "standard": (Standard(NUMERIC), 2), "ordinal": (Ordinal(CATEGORICAL), 2),
              "target": (Target(CATEGORICAL), 2), "mean": (Impute(NUMERIC), 2), "classmean": (ClassMeanImpute(NUMERIC), 2),
              "robust_approx": (Robust(NUMERIC, relative_error=0.001), 2),
              "yeojohnson": (YeoJohnson(NUMERIC), 6), "robust_exact": (Robust(NUMERIC), 9),
              "fence_exact": (Fence(NUMERIC, 0.01, 0.99), 9)}
    try:
        for name, (est, limit) in limits.items():
            sc.setJobGroup(f"fit-{name}", name)
            est.fit(df)
            n = len(sc.statusTracker().getJobIdsForGroup(f"fit-{name}"))
            assert 1 <= n <= limit, (name, n)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        df.unpersist()
