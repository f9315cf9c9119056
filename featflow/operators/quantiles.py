"""Quantiles of many columns, exact or approximate, without holding a column
in one task.

Exact mode (``relative_error == 0``, default) uses linear interpolation
between the k-th and (k+1)-th smallest values, k = floor((n - 1) p) - the rule
of pandas / numpy and SQL ``quantile_cont``. It is computed in a few passes
with bounded memory:

  1. one job: per column the count and a ``percentile_approx`` sketch at
     p - d and p + d for every target p (rank error <= n / accuracy), which
     brackets the two wanted ranks;
  2. per target, the number of rows below the bracket and the DISTINCT
     values inside it with their counts (ties collapse, so a value holding a
     third of the rows is one record); only targets with at most
     ``max_collect`` distinct values in the bracket send them to the driver;
  3. a target whose bracket holds more distinct values is narrowed with an
     equi-width histogram of ``bins`` buckets inside its bracket (bounded
     output) and retried; a bracket the sketch missed widens to min..max.

Approximate mode (``relative_error > 0``) is one ``percentile_approx`` job.
Grouped quantiles (``group_quantiles``) take any number of groups: counts of
distinct values, placed by prefix sums, and a table as the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featflow.operators.ranking import join_null_safe, prefix_sums
from featflow.session import ensure_checkpoint_dir

ACCURACY = 10000
MAX_COLLECT = 200000


def quantile_expr(c: str, probs: Sequence[float], relative_error: float = 0.0) -> Column:
    """Single-aggregate quantiles (used per group): exact ``percentile`` or
    ``percentile_approx``."""
    probs = [float(p) for p in probs]
    x = F.col(f"`{c}`").cast("double")
    if relative_error and relative_error > 0:
        acc = max(1, int(round(1.0 / relative_error)))
        return F.percentile_approx(x, probs, acc)
    return F.percentile(x, F.array(*[F.lit(p) for p in probs]))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.col(f"`{c}`").cast("double").alias("x"))
                                          for i, c in enumerate(cols)])).alias("p"))
              .select("p.ci", "p.x").where(F.col("x").isNotNull() & ~F.isnan("x")))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY,
                    max_collect: int = MAX_COLLECT, max_passes: int = 12, bins: int = 1000) -> dict:
    cols, probs = list(cols), [float(p) for p in probs]
    long = _long(df, cols)
    d = 3.0 / accuracy
    sketch_ps = [min(1.0, max(0.0, q)) for p in probs for q in (p - d, p + d)]
    rows = {r["ci"]: r for r in long.groupBy("ci").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"),
        F.percentile_approx("x", sketch_ps, accuracy).alias("q")).collect()}      # one row per column
    out = {c: [None] * len(probs) for c in cols}
    targets = {}
    for i, c in enumerate(cols):
        r = rows.get(i)
        if r is None or not r["n"]:
            continue
        n = r["n"]
        for j, p in enumerate(probs):
            h = (n - 1) * p
            k = int(math.floor(h))
            targets[(i, j)] = {"k": k, "k2": min(k + 1, n - 1), "frac": h - k, "mn": r["mn"], "mx": r["mx"],
                               "lo": r["q"][2 * j], "hi": r["q"][2 * j + 1]}
    spark = df.sparkSession
    for _ in range(max_passes):
        if not targets:
            break
        keys = list(targets)
        tt = spark.createDataFrame([(ti, key[0], float(targets[key]["lo"]), float(targets[key]["hi"]))
                                    for ti, key in enumerate(keys)], "ti int, ci int, lo double, hi double")
        j = long.join(F.broadcast(tt), "ci")             # targets table: cols x probs rows
        inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
        # one record per (target, distinct in-bracket value), plus one "below" record per target
        side = F.when(F.col("x") < F.col("lo"), F.lit(-1)).when(inside, F.lit(0)).otherwise(F.lit(1))
        grouped = (j.select("ti", side.alias("side"), F.when(inside, F.col("x")).alias("x"))
                    .groupBy("ti", "side", "x").agg(F.count(F.lit(1)).alias("cnt")))
        per_value = grouped.where(F.col("side") == 0).select("ti", "x", "cnt")
        stat_rows = grouped.groupBy("ti").agg(                                   # ONE job: <= targets rows
            F.sum(F.when(F.col("side") == -1, F.col("cnt"))).alias("b"),
            F.sum(F.when(F.col("side") == 0, F.col("cnt"))).alias("n_in"),
            F.sum((F.col("side") == 0).cast("long")).alias("nd")).collect()
        below = {r["ti"]: r["b"] for r in stat_rows}
        stats = {r["ti"]: r for r in stat_rows if r["n_in"]}
        small, wide, retry = [], [], {}
        for ti, key in enumerate(keys):
            t = targets[key]
            b = below.get(ti, 0) or 0
            st = stats.get(ti)
            n_in = st["n_in"] if st else 0
            if not (b <= t["k"] and b + n_in > t["k2"]):    # the sketch bracket missed: whole range
                retry[key] = dict(t, lo=t["mn"], hi=t["mx"])
            elif st["nd"] <= max_collect:
                small.append((ti, key, b))
            else:
                wide.append((ti, key, b))
        if small:   # bounded: at most max_collect distinct values per target
            ids = [ti for ti, _, _ in small]
            vals = {}
            for r in per_value.where(F.col("ti").isin(ids)).collect():
                vals.setdefault(r["ti"], []).append((r["x"], r["cnt"]))
            for ti, key, b in small:
                t, vs = targets[key], sorted(vals.get(ti, []))

                def at(rank, vs=vs, b=b):
                    acc = b
                    for v, cnt in vs:
                        acc += cnt
                        if acc > rank:
                            return v
                    return vs[-1][0]
                a, c2 = at(t["k"]), at(t["k2"])
                out[cols[key[0]]][key[1]] = a + t["frac"] * (c2 - a) if t["frac"] else a
        if wide:    # too many distinct values: narrow with an equi-width histogram inside the bracket
            ids = [ti for ti, _, _ in wide]
            width = (F.col("hi") - F.col("lo")) / bins
            bk = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
            hist = {}
            for r in j.where(inside & F.col("ti").isin(ids)).groupBy("ti", bk.alias("bk")).agg(
                    F.count(F.lit(1)).alias("cnt")).collect():                       # <= targets x bins rows
                hist.setdefault(r["ti"], []).append((r["bk"], r["cnt"]))
            for ti, key, b in wide:
                t = targets[key]
                w = (t["hi"] - t["lo"]) / bins
                acc, b_lo, b_hi = b, None, None
                for bkt, cnt in sorted(hist.get(ti, [])):
                    if b_lo is None and acc + cnt > t["k"]:
                        b_lo = bkt
                    acc += cnt
                    if acc > t["k2"]:
                        b_hi = bkt
                        break
                lo = t["lo"] + b_lo * w
                hi = t["lo"] + (b_hi + 1) * w if b_hi < bins - 1 else t["hi"]
                retry[key] = dict(t, lo=lo, hi=max(hi, lo))
        targets = retry
    if targets:
        raise RuntimeError("exact quantiles did not converge")
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     relative_error: float = 0.0, by: str | None = None) -> dict:
    """{col: [q...]} (or {group: {col: [q...]}} with ``by``)."""
    if by is None:
        if relative_error and relative_error > 0:
            row = df.agg(*[quantile_expr(c, probs, relative_error).alias(f"q{i}") for i, c in enumerate(cols)]).first()
            return {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                    for i, c in enumerate(cols)}
        return exact_quantiles(df, cols, probs)
    df = df.withColumn(by, F.col(by).cast("string"))       # group keys as Spark writes them
    if relative_error and relative_error > 0:
        aggs = [quantile_expr(c, probs, relative_error).alias(f"q{i}") for i, c in enumerate(cols)]
        out = {}
        for row in df.groupBy(by).agg(*aggs).collect():  # one row per group (few groups)
            out[str(row[by])] = {c: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)
                                 for i, c in enumerate(cols)}
        return out
    out = {}
    for row in group_quantiles(df, cols, probs, [by]).collect():    # for few groups; ``group_quantiles`` stays a table
        out.setdefault(str(row[by]), {c: [None] * len(probs) for c in cols})[row["column"]] = list(row["q"])
    return out


MAX_GROUPS = 1000


def group_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Exact quantiles of any number of groups: (by..., column, n, q), q an
    array in the order of ``probs`` (linear interpolation; null without
    values). The columns are unpivoted and reduced to counts of distinct
    values; two-level prefix sums place every value in its group without a
    task that holds a group, and the values at the wanted ranks are picked by
    one aggregate that combines before its shuffle. Nulls and NaN are left out."""
    by = list(by)
    ensure_checkpoint_dir(df.sparkSession)
    own = [F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)]
    keys = [f"_by{i}" for i in range(len(by))] + ["column"]
    long = df.select(*own, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(keys[:-1], list(cols), "column", "x")
    counts = long.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    placed = prefix_sums(counts, keys, "x", ["n"])
    ranked = join_null_safe(placed, counts.groupBy(*keys).agg(F.sum("n").alias("_total")), keys)
    picked, frac = [], []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_total") - 1)
        for name, k in ((f"a{i}", low), (f"b{i}", high)):
            picked.append(F.max(F.when((F.col("n_cum") <= k) & (k < F.col("n_cum") + F.col("n")), F.col("x"))).alias(name))
        frac.append(F.max(at - low).alias(f"f{i}"))
    values = [F.when(F.col(f"f{i}") == 0, F.col(f"a{i}")).otherwise(F.col(f"a{i}") + F.col(f"f{i}") * (F.col(f"b{i}") - F.col(f"a{i}")))
              for i in range(len(probs))]
    found = ranked.groupBy(*keys).agg(*picked, *frac, F.max("_total").alias("n"))
    return found.select(*[F.col(f"_by{i}").alias(b) for i, b in enumerate(by)], "column", "n", F.array(*values).alias("q"))
