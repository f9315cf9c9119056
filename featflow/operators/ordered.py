"""Ordered target statistics of categorical columns.

A row's category becomes the smoothed mean of the target over the rows of
that category that come before it in a seeded order: its own target is never
used, so a model may train on the value. New rows get the statistic over all
training rows. The running sums are exact two-level prefix sums, so a category
that a third of all rows share is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featflow.operators.joins import broadcast_if_small
from featflow.operators.ranking import hash_rank, prefix_sums
from featflow.session import ensure_checkpoint_dir


def ordered_target(train: DataFrame, cols: Sequence[str], key: str, label: str = "label", prior_rows: float = 1.0, seed: int = 42,
                   suffix: str = "_ots") -> DataFrame:
    """``train`` with ``col + suffix``: (sum of earlier targets of the category
    + prior_rows * p) / (earlier rows + prior_rows), p the mean target. The
    order is that of the seeded hash of ``key`` (unique); a null is a category."""
    ensure_checkpoint_dir(train.sparkSession)
    p = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    rows = hash_rank(train, key, by=(), seed=seed, name="_at").withColumn("_y", F.col(label).cast("double")).withColumn("_one", F.lit(1.0)).checkpoint()
    for c in cols:
        rows = prefix_sums(rows, [c], "_at", ["_y", "_one"])
        value = (F.col("_y_cum") + prior_rows * p) / (F.col("_one_cum") + prior_rows)
        rows = rows.withColumn(f"{c}{suffix}", value).drop("_y_cum", "_one_cum")
    return rows.drop("_at", "_y", "_one")


def full_target(train: DataFrame, new: DataFrame, cols: Sequence[str], label: str = "label", prior_rows: float = 1.0,
                suffix: str = "_ots") -> DataFrame:
    """``new`` with the statistics over all of ``train``; unseen categories get p."""
    y = F.col(label).cast("double")
    p = train.agg(F.avg(y).alias("p")).first()["p"]
    out = new
    for c in cols:
        name = f"{c}{suffix}"
        table = train.groupBy(F.col(f"`{c}`").alias("_level")).agg(((F.sum(y) + prior_rows * p) / (F.count(y) + prior_rows)).alias(name))
        out = out.join(broadcast_if_small(table), F.col(f"`{c}`").eqNullSafe(F.col("_level")), "left").drop("_level")
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(p)))
    return out


__all__ = ["ordered_target", "full_target"]
