"""Exact, seeded, distributed row ranking.

Seeded order = ``md5(concat_ws('|', seed, key))``: reproducible and identical
in any SQL engine. The rank inside a group is computed in two levels so no
single task ever sees a whole group: rows are bucketed by a hex prefix of the
hash (uniform by construction, so a group holding a third of the data is
still split evenly), per-(group, bucket) counts give offsets over a small
table, and a window partitioned by (group, bucket) numbers rows locally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featflow.functions.parse import col_of


def seeded_hash(key, seed: int | str = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), col_of(key).cast("string")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where a null key equals a null key, so rows of
    the null group stay."""
    other = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    return left.join(other, same).drop(*[f"_r_{i}" for i in range(len(keys))])


def hash_rank(df: DataFrame, key: str, by: Sequence[str] = (), seed: int | str = 42,
              name: str = "rank", prefix_len: int = 4) -> DataFrame:
    """Add ``name`` = 1-based row_number() within ``by`` ordered by the seeded
    hash of ``key`` (ties broken by the key itself).

    ``prefix_len`` hex digits give 16**prefix_len buckets per group (65,536 by
    default: ~15 M rows per window task at 10**12 rows; the offsets table is
    groups x buckets rows, about 1 MB per group)."""
    h = seeded_hash(key, seed)
    d = df.withColumn("_h", h).withColumn("_bkt", F.substring("_h", 1, prefix_len))
    counts = d.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bkt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    d = join_null_safe(d, offsets, [*by, "_bkt"])
    w2 = Window.partitionBy(*by, "_bkt").orderBy("_h", key)
    return (d.withColumn(name, (F.row_number().over(w2) + F.col("_off")).cast("bigint"))
             .drop("_h", "_bkt", "_off"))


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str],
                n_buckets: int = 1024, inclusive: bool = False, suffix: str = "_cum") -> DataFrame:
    """Running sums of ``values`` in ascending ``order`` within ``by``,
    without a one-task window.

    Rows are bucketed by approximate quantiles of ``order`` (at most
    ``n_buckets`` - 1 cut points, looked up by binary search), bucket totals
    give offsets over a groups x buckets table, and the local running sum is
    a window per (group, bucket). The result is exact whatever the cuts are;
    they only balance the work. ``inclusive=False`` sums strictly preceding
    rows only. ``order`` must be unique within ``by`` (aggregate first).
    """
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = []
    if probs:  # one small job: n_buckets - 1 numbers reach the driver
        row = df.agg(F.percentile_approx(order, probs, 10000).alias("q")).first()
        cuts = sorted(set(float(x) for x in (row["q"] or []) if x is not None and not math.isnan(x)))
    if cuts:
        # JVM binary search per row; buckets are monotone in ``order`` (NaN last)
        splits = [-math.inf] + cuts + [math.inf]
        d = Bucketizer(splits=splits, inputCol="_ord", outputCol="_bkt", handleInvalid="keep").transform(
            df.withColumn("_ord", F.col(order).cast("double")))
        d = d.withColumn("_bkt", F.col("_bkt").cast("int")).drop("_ord")
    else:
        d = df.withColumn("_bkt", F.lit(0))
    tot = d.groupBy(*by, "_bkt").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wb = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_bkt", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_o_{v}")
                                     for v in values])
    d = join_null_safe(d, offs, [*by, "_bkt"])
    hi = 0 if inclusive else -1
    wl = Window.partitionBy(*by, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, hi)
    cols = [(F.coalesce(F.sum(v).over(wl), F.lit(0)) + F.col(f"_o_{v}")).alias(f"{v}{suffix}") for v in values]
    return d.select(*df.columns, *cols)
