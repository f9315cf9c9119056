"""Imputation (C1-C8): fit statistics once, fill lazily.

``Impute(strategy)``: constant | label | mean | median | mode, optionally per
group (``by``: e.g. each split by its own statistics, the C4/C5 variants).
``ClassMeanImpute``: C7 - training rows by their class mean, other rows by
the mean of the already-filled training column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featflow.functions.parse import literal_map
from featflow.operators.base import StatEstimator, StatModel, ordered_columns
from featflow.operators.joins import broadcast_if_small
from featflow.operators.quantiles import MAX_GROUPS, group_quantiles, quantile_expr
from featflow.operators.stats import write_stats


def _stat(c: str, strategy: str, relative_error: float):
    x = F.col(f"`{c}`")
    if strategy == "mean":
        return F.avg(x)
    if strategy == "median":
        return quantile_expr(c, [0.5], relative_error)[0]
    raise ValueError(strategy)


def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> list[DataFrame]:
    """A table (by..., column, value) for each data type among ``cols``:
    the most frequent value, the lowest among equals. Values are counted with
    partial sums first, so no buffer holds a column's distinct values."""
    kinds: dict[str, list[str]] = {}
    for c in cols:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = []
    for names in kinds.values():
        long = df.select(*by, *[F.col(f"`{c}`") for c in names]).unpivot(list(by), names, "column", "value").where(F.col("value").isNotNull())
        counts = long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
        first = F.min(F.struct((-F.col("n")).alias("n"), "value"))
        out.append(counts.groupBy(*by, "column").agg(first.alias("m")).select(*by, "column", F.col("m.value").alias("value")))
    return out


class ImputeModel(StatModel):
    def apply(self, df, conf, stats):
        rep = {}
        by = conf.get("by")
        if stats.get("path"):           # more groups than a literal map should hold
            table = broadcast_if_small(df.sparkSession.read.parquet(stats["path"]), MAX_GROUPS * 100)
            out = df.join(table, F.col(f"`{by}`").cast("string") == F.col("_by"), "left")
            return out.select(*ordered_columns(df, {c: F.coalesce(F.col(f"`{c}`"), F.col(f"_s{i}")) for i, c in enumerate(conf["cols"])}))
        for c in conf["cols"]:
            if by:
                per = {g: v[c] for g, v in stats["by_group"].items() if v.get(c) is not None}
                if per:
                    rep[c] = F.coalesce(F.col(f"`{c}`"),
                                        F.try_element_at(literal_map(per), F.col(by).cast("string")))
            else:
                v = stats["values"].get(c)
                if v is not None:
                    rep[c] = F.coalesce(F.col(f"`{c}`"), F.lit(v))
        return df.select(*ordered_columns(df, rep))


class Impute(StatEstimator):
    model_class = ImputeModel

    def __init__(self, cols: Sequence[str] = (), strategy: str = "mean", value=None,
                 by: str | None = None, relative_error: float = 0.0):
        super().__init__(cols=list(cols), strategy=strategy, value=value, by=by,
                         relative_error=relative_error)

    def compute(self, df, conf):
        cols, st = conf["cols"], conf["strategy"]
        if st in ("constant", "label"):
            v = conf["value"] if conf["value"] is not None else (0 if st == "constant" else "Unknown")
            return {"values": {c: v for c in cols}}
        if conf.get("by"):
            return self._by_group(df, conf)
        if st == "mode":
            found = {r["column"]: r["value"] for t in modes(df, cols) for r in t.collect()}         # one row a column
            return {"values": {c: found.get(c) for c in cols}}
        if st == "median" and not conf["relative_error"]:   # distributed exact median
            from featflow.operators.quantiles import column_quantiles
            q = column_quantiles(df, cols, [0.5], 0.0)
            return {"values": {c: q[c][0] for c in cols}}
        aggs = [_stat(c, st, conf["relative_error"]).alias(f"s{i}") for i, c in enumerate(cols)]
        row = df.agg(*aggs).first()
        return {"values": {c: row[f"s{i}"] for i, c in enumerate(cols)}}

    @staticmethod
    def _by_group(df, conf):
        """Statistics of each group: a literal map for up to MAX_GROUPS
        groups, else a table in the shared folder that is joined."""
        cols, st = conf["cols"], conf["strategy"]
        own = df.select(F.col(f"`{conf['by']}`").cast("string").alias("_by"), *[F.col(f"`{c}`") for c in cols]).where("_by is not null")
        picked = lambda value: [F.max(F.when(F.col("column") == c, value)).alias(f"_s{i}") for i, c in enumerate(cols)]
        if st == "median" and not conf["relative_error"]:
            table = group_quantiles(own, cols, [0.5], ["_by"]).groupBy("_by").agg(*picked(F.col("q")[0]))
        elif st == "mode":
            table = own.select("_by").distinct()
            for t in modes(own, cols, ["_by"]):
                names = {f"_s{i}": c for i, c in enumerate(cols) if t.schema["value"].dataType == own.schema[c].dataType}
                wide = t.groupBy("_by").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(n) for n, c in names.items()])
                table = table.join(wide, "_by", "left")
        else:
            table = own.groupBy("_by").agg(*[_stat(c, st, conf["relative_error"]).alias(f"_s{i}") for i, c in enumerate(cols)])
        rows = table.limit(MAX_GROUPS + 1).collect()
        if len(rows) > MAX_GROUPS:
            return {"path": write_stats(table)}
        return {"by_group": {r["_by"]: {c: r[f"_s{i}"] for i, c in enumerate(cols)} for r in rows}}


class ClassMeanImputeModel(StatModel):
    def apply(self, df, conf, stats):
        """Rows of unknown class (test) get the filled-train mean."""
        rep = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in stats["overall"].items() if v is not None}
        return df.select(*ordered_columns(df, rep))

    def transform_labeled(self, df: DataFrame) -> DataFrame:
        """Training rows: fill by the mean of the row's own class (rows
        without a class by the filled-train mean)."""
        conf, stats = self.conf, self.fitted
        label = conf["label"]
        rep = {}
        for c in stats["overall"]:
            per = {k: v[c] for k, v in stats["class_means"].items() if v.get(c) is not None}
            rep[c] = F.coalesce(F.col(f"`{c}`"), F.try_element_at(literal_map(per), F.col(label).cast("string")) if per else F.lit(None),
                                F.when(F.col(label).isNull(), F.lit(stats["overall"][c])))
        return df.select(*ordered_columns(df, rep))


class ClassMeanImpute(StatEstimator):
    """Only columns with missing training values are touched."""
    model_class = ClassMeanImputeModel

    def __init__(self, cols: Sequence[str] = (), label: str = "label"):
        super().__init__(cols=list(cols), label=label)

    def compute(self, df, conf):
        cols, label = conf["cols"], conf["label"]
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(cols):
            aggs += [F.sum(F.col(f"`{c}`")).alias(f"s{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}")]
        rows = df.groupBy(F.col(label).cast("string").alias("_class")).agg(*aggs).collect()  # one row per class
        class_means, overall = {}, {}
        for i, c in enumerate(cols):
            if sum(r["_rows"] - r[f"n{i}"] for r in rows) == 0:
                continue
            tot, n = 0.0, 0
            for r in rows:
                k = r["_class"]
                m = (r[f"s{i}"] / r[f"n{i}"]) if r[f"n{i}"] and k is not None else None
                if k is not None:
                    class_means.setdefault(k, {})[c] = m
                if m is not None:
                    tot += r[f"s{i}"] + (r["_rows"] - r[f"n{i}"]) * m
                    n += r["_rows"]
                else:
                    tot += r[f"s{i}"] or 0.0
                    n += r[f"n{i}"]
            overall[c] = tot / n if n else None
        return {"class_means": class_means, "overall": overall}
