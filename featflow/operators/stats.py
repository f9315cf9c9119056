"""Profiling statistics, each computed in ONE aggregate job over all columns.

Wide-to-long reshaping uses ``unpivot`` (a narrow Expand, no shuffle) so a
per-column statistic over many columns is a single grouped aggregate.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featflow.functions.parse import round6
from featflow.session import ensure_checkpoint_dir


def write_stats(table: DataFrame) -> str:
    """``table`` as Parquet in the shared checkpoint folder; the path."""
    path = f"{ensure_checkpoint_dir(table.sparkSession).rstrip('/')}/featflow-stats-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path


def rate_by_group(df: DataFrame, by: str | Sequence[str], label: str = "label") -> DataFrame:
    """row count and mean of the target per group."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), round6(F.avg(label)).alias("rate"))


def long_values(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """(column, value) rows with values cast to string."""
    ids = [key] if key else []
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]) \
             .unpivot(ids, list(columns), "column", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """value counts of every listed column, NULL counted as its own value."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column (one pass), long form (column, n_null)."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "n_null") \
              .select("column", F.coalesce("n_null", F.lit(0)).cast("bigint").alias("n_null"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """distinct non-NULL values per column. Exact mode shuffles
    (column, value) pairs once; ``approx`` uses HyperLogLog sketches."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])
        return row.unpivot([], list(columns), "column", "n_distinct")
    return (long_values(df, columns).where(F.col("value").isNotNull()).distinct()
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))


def recast_low_cardinality(df: DataFrame, columns: Sequence[str], below: int = 10) -> list[str]:
    """Numeric ``columns`` with fewer than ``below`` distinct values: those to
    treat as categories (cast them to string on every split alike)."""
    few = distinct_counts(df, columns, approx=False).where(F.col("n_distinct") < below)
    found = {r["column"] for r in few.collect()}                      # at most one row per column
    empty = {r["column"] for r in null_counts(df, columns).where(F.col("n_null") == df.count()).collect()}
    return [c for c in columns if c in found | empty]


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, share of the total, table width."""
    total = Window.partitionBy()  # over the <= n_classes aggregated rows only
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .select(label, "n", round6(F.col("n") / F.sum("n").over(total)).alias("share"),
                      F.lit(len(df.columns)).cast("bigint").alias("n_columns")))


def _gram(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[pa.RecordBatch]:
    """Sums over the partition for every pair of column blocks: rows where
    both are present, and there the sums of x, x^2 and x * y."""
    starts = range(0, width, block)
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        col = batch.column("x")
        if not len(col):
            continue
        flat = col.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        m = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
        x = np.where(m > 0, x, 0.0)
        sq = x * x
        for i in starts:
            a = slice(i, i + block)
            for j in starts:
                b = slice(j, j + block)
                part = np.stack([m[:, a].T @ m[:, b], x[:, a].T @ m[:, b], sq[:, a].T @ m[:, b], x[:, a].T @ x[:, b]])
                sums[i, j] = sums[i, j] + part if (i, j) in sums else part
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()),
                                      pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "sums"])


def _correlations(batches: Iterator[pa.RecordBatch], cols: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """Block sums as (a, b, corr) rows; rows of the mirrored blocks arrive
    under the same unordered pair of blocks."""
    def size(i: int) -> int:
        return min(block, len(cols) - i)

    def rows(key: tuple, total: dict) -> pa.RecordBatch:
        i, j = key
        n, sa, qa, xy = total[i, j].reshape(4, size(i), size(j))
        _, sb, qb, _ = total[j, i].reshape(4, size(j), size(i))
        sb, qb = sb.T, qb.T
        with np.errstate(all="ignore"):
            va, vb = qa / n - (sa / n) ** 2, qb / n - (sb / n) ** 2
            flat = (va <= 1e-14 * qa / n) | (vb <= 1e-14 * qb / n)
            corr = (xy / n - sa / n * (sb / n)) / np.sqrt(va * vb)
        out = []
        for r in range(size(i)):
            for c in range(size(j)):
                value = None if not n[r, c] or flat[r, c] else float(corr[r, c])
                out.append((cols[i + r], cols[j + c], value))
                if i != j:
                    out.append((cols[j + c], cols[i + r], value))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()),
                                           pa.array([o[2] for o in out], pa.float64())], names=["a", "b", "corr"])

    key, total = None, {}
    for batch in batches:
        for i, j, raw in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "sums"))):
            if (min(i, j), max(i, j)) != key:
                if key is not None:
                    yield rows(key, total)
                key, total = (min(i, j), max(i, j)), {}
            got = np.frombuffer(raw)
            total[i, j] = total[i, j] + got if (i, j) in total else got
    if key is not None:
        yield rows(key, total)


def corr_long(df: DataFrame, cols: Sequence[str], block: int = 128) -> DataFrame:
    """the full correlation matrix in long form (a, b, corr), each pair
    over the rows where both are present; null for a pair without variance.
    Rows are read twice, for a shift of every column (its mean, or its only
    value) and for the Gram matrix: every partition adds up blocks of
    ``block`` x ``block`` outer products and presence masks, the blocks are
    added up by pair of blocks, and no row is copied."""
    cols = list(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    stats = df.agg(*[F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.avg(v)).alias(f"s{k}") for k, v in enumerate(x)]).first()
    shifted = [v - F.lit(stats[f"s{k}"] if stats[f"s{k}"] is not None and math.isfinite(stats[f"s{k}"]) else 0.0) for k, v in enumerate(x)]
    sums = df.select(F.array(*shifted).alias("x")).mapInArrow(partial(_gram, width=len(cols), block=block), "i int, j int, sums binary")
    lead = [F.least("i", "j"), F.greatest("i", "j")]
    return sums.repartition(*lead).sortWithinPartitions(*lead, "i").mapInArrow(partial(_correlations, cols=cols, block=block), "a string, b string, corr double")


def target_corr(df: DataFrame, cols: Sequence[str], label: str = "label", fill: float | None = 0.0) -> DataFrame:
    """(feature, corr, n_present): correlation of each feature (NULL -> fill)
    with the target. One scan: the features are unpivoted to (feature, x, y)
    rows (a narrow Expand) and aggregated per feature - a small expression
    per row instead of one very wide aggregate."""
    long = df.select(F.col(label).cast("double").alias("_y"),
                     *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) \
             .unpivot(["_y"], list(cols), "feature", "x")
    x = F.col("x")
    xf = F.coalesce(x, F.lit(fill)) if fill is not None else x
    y = F.col("_y")
    return long.groupBy("feature").agg(
        F.try_divide(F.covar_pop(xf, y), F.stddev_pop(xf) * F.stddev_pop(F.when(xf.isNotNull(), y))).alias("corr"),
        F.count(x).alias("n_present"))


def leak_screen(df: DataFrame, cols: Sequence[str], label: str = "label", threshold: float = 0.7,
                top: int | None = 10) -> DataFrame:
    """features whose correlation (NULL -> 0) with the target exceeds
    ``threshold`` in absolute value, strongest first: the first ``top`` as a
    report, or with None all of them; all-NULL columns are skipped."""
    tc = target_corr(df, cols, label).where((F.col("n_present") > 0) & (F.abs("corr") > threshold))
    w = Window.orderBy(F.abs("corr").desc(), F.col("feature"))   # over <= len(cols) rows
    ranked = tc.select("feature", "corr", F.row_number().over(w).cast("int").alias("rank"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def importance(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """Univariate importance table (feature, importance): |corr| with the
    target, normalised to sum 1 (a data-derived stand-in for model
    importances where an exact oracle is needed)."""
    tc = target_corr(df, cols, label).select("feature", F.coalesce(F.abs("corr"), F.lit(0.0)).alias("raw"))
    return tc.select("feature", (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("importance"))


def top_k(imp: DataFrame, k: int, value: str = "importance", name: str = "feature") -> DataFrame:
    """Sort descending (name breaks ties) and keep k - a top-k report."""
    return imp.orderBy(F.col(value).desc(), F.col(name)).limit(k)


def select_cumulative(imp: DataFrame, threshold: float = 0.8, at_least: int = 10,
                      value: str = "importance", name: str = "feature") -> DataFrame:
    """Normalise, running share in descending order, keep share <= threshold;
    if fewer than ``at_least`` pass, keep the top ``at_least`` instead."""
    w_all = Window.partitionBy()
    w = Window.orderBy(F.col("norm").desc(), F.col(name))
    t = imp.select(name, (F.col(value) / F.sum(value).over(w_all)).alias("norm"))
    t = t.select(name, "norm", F.sum("norm").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                 F.row_number().over(w).alias("rank"))
    t = t.withColumn("n_pass", F.sum((F.col("cum") <= threshold).cast("int")).over(w_all))
    return t.where(F.when(F.col("n_pass") >= at_least, F.col("cum") <= threshold)
                   .otherwise(F.col("rank") <= at_least)).drop("n_pass")


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), relative_error: float = 0.0) -> DataFrame:
    """count, mean, sample sd, min, quartiles (linear interpolation), max
    of every column. Moments: ONE scan over the unpivoted (column, x) rows
    aggregated per (group, column); quartiles: the distributed exact
    algorithm for any number of groups, or ``percentile_approx``."""
    from featflow.operators.quantiles import group_quantiles, quantile_expr
    by = list(by)
    long = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) \
             .unpivot(by, list(cols), "column", "x")
    x = F.col("x")
    moments = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
               F.min(x).alias("min"), F.max(x).alias("max")]
    if relative_error and relative_error > 0:
        agg = long.groupBy(*by, "column").agg(*moments, quantile_expr("x", [0.25, 0.5, 0.75], relative_error).alias("_q"))
        return agg.select(*by, "column", "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                          F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")
    q = group_quantiles(long.withColumnRenamed("column", "_of"), ["x"], [0.25, 0.5, 0.75], by + ["_of"])
    q = q.select(*by, F.col("_of").alias("column"), F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))
    agg = long.groupBy(*by, "column").agg(*moments)
    keys = by + ["column"]
    q = q.select(*[F.col(f"`{k}`").alias(f"_q{i}") for i, k in enumerate(keys)], "p25", "p50", "p75")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_q{i}")) for i, k in enumerate(keys)]
    return agg.join(q, same, "left").select(*by, "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
