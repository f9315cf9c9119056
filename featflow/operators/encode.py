"""Categorical encoders.

Fitting collects the level table of all columns in ONE job: the columns are
unpivoted to (column, value) and aggregated (map-side partial aggregation,
then a shuffle of distinct levels only). A level table of at most
``max_levels`` rows travels with the model: columns of up to
``LITERAL_LEVELS`` levels as a literal map inside the projection, longer ones
as a broadcast join of that bounded table. A larger level table is written to
the shared checkpoint folder and joined per column; AQE turns each join into
a broadcast only when the runtime size allows it, otherwise it stays a
sort-merge join. ``levels``, ``inverse`` and the check for unseen levels work
alike on both; ``keep_levels`` moves a written table to a lasting place.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featflow.functions.parse import literal_map
from featflow.operators.base import StatEstimator, StatModel, ordered_columns
from featflow.operators.stats import long_values
from featflow.session import ensure_checkpoint_dir

MAX_LEVELS = 50000
LITERAL_LEVELS = 100


def _table_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/featflow-levels-{uuid.uuid4().hex}"


def fit_levels(df: DataFrame, cols: Sequence[str], label: str | None = None,
               max_levels: int = MAX_LEVELS):
    """Level table (column, value, code[, n, mean]). Returns ``(rows, None)``
    when it has at most ``max_levels`` rows, else ``(None, path)`` of the
    written table. Codes follow the sorted (code point) order of the values."""
    lv = long_values(df, cols, key=label)
    if label:
        agg = lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"),
                                                  F.avg(F.col(label).cast("double")).alias("mean"))
    else:
        agg = lv.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = agg.limit(max_levels + 1).collect()
    if len(rows) <= max_levels:
        return rows, None
    path = _table_path(df.sparkSession)
    _coded(agg).write.parquet(path)
    return None, path


def _coded(agg: DataFrame) -> DataFrame:
    """Codes in value order without one window per column: the levels are
    dealt out by range, numbered inside each range and shifted by the levels
    of the ranges before it (columns x ranges offsets)."""
    spark = agg.sparkSession
    ranged = _table_path(spark)
    agg.repartitionByRange("column", F.col("value").asc_nulls_last()).withColumn("part", F.spark_partition_id()) \
       .write.parquet(ranged)
    t = spark.read.parquet(ranged)
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = t.groupBy("column", "part").agg(F.count(F.lit(1)).alias("_n")) \
               .select("column", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("column", "part").orderBy(F.col("value").asc_nulls_last())
    return t.withColumn("_place", F.row_number().over(inside)).join(offsets, ["column", "part"]) \
            .withColumn("code", (F.col("_before") + F.col("_place") - 1).cast("int")).drop("part", "_place", "_before")


def _lookup(df: DataFrame, c: str, mapping: dict, dtype: str, name: str) -> tuple[DataFrame, Column]:
    """``df`` and the expression of the mapped value of column ``c``: a
    literal map up to LITERAL_LEVELS entries, else a broadcast join of the
    mapping, which the fit bounds by ``max_levels`` rows."""
    x = F.col(f"`{c}`").cast("string")
    if not mapping:
        return df, F.lit(None).cast(dtype)
    if len(mapping) <= LITERAL_LEVELS:
        return df, F.try_element_at(literal_map(mapping), x)
    t = df.sparkSession.createDataFrame(list(mapping.items()), f"`{name}_k` string, `{name}` {dtype}")
    return df.join(F.broadcast(t), x == F.col(f"{name}_k"), "left").drop(f"{name}_k"), F.col(name)


def keep_levels(model: StatModel, path: str) -> StatModel:
    """The model with its written level table copied to ``path``, a lasting
    folder, so that a saved model does not point into the checkpoint folder.
    A model that carries its levels is returned as it is."""
    stats = model.fitted
    if not stats.get("path"):
        return model
    SparkSession.active().read.parquet(stats["path"]).write.parquet(path)
    return type(model)(config=json.dumps(model.conf), stats=json.dumps(stats | {"path": path}))


def _codes(rows, cols):
    per = {c: sorted(r["value"] for r in rows if r["column"] == c and r["value"] is not None) for c in cols}
    return {c: {v: i for i, v in enumerate(vals)} for c, vals in per.items()}


class OrdinalModel(StatModel):
    def apply(self, df, conf, stats):
        unknown, missing = conf["unknown"], conf["missing"]
        if stats.get("path"):
            return self._apply_table(df, conf, stats["path"])
        rep, out = {}, df
        for i, c in enumerate(conf["cols"]):
            out, hit = _lookup(out, c, stats["codes"].get(c, {}), "int", f"_code{i}")
            rep[c] = F.when(F.col(f"`{c}`").isNull(), F.lit(missing).cast("int")) \
                      .otherwise(F.coalesce(hit, F.lit(unknown))).cast("int")
        return out.select(*ordered_columns(df, rep))

    def _apply_table(self, df, conf, path):
        table = df.sparkSession.read.parquet(path)
        out = df
        for i, c in enumerate(conf["cols"]):
            t = table.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"),
                                                         F.col("code").alias(f"_c{i}"))
            out = out.join(t, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left")
            x = F.col(f"`{c}`")
            out = out.withColumn(c, F.when(x.isNull(), F.lit(conf["missing"]).cast("int"))
                                 .otherwise(F.coalesce(F.col(f"_c{i}"), F.lit(conf["unknown"]))).cast("int")) \
                     .drop(f"_v{i}", f"_c{i}")
        return out

    def level_table(self) -> DataFrame:
        """(column, value, code) of every level, whatever the model's size."""
        stats, spark = self.fitted, SparkSession.active()
        if stats.get("path"):
            return spark.read.parquet(stats["path"]).select("column", "value", "code")
        return spark.createDataFrame([(c, v, i) for c, m in stats["codes"].items() for v, i in m.items()],
                                     "column string, value string, code int")

    def levels(self) -> dict:
        """Levels in code order, for a model that carries them; a written
        table is not collected: use ``level_table``."""
        if self.fitted.get("path"):
            raise ValueError("levels are in a written table: use level_table()")
        return {c: sorted(m, key=m.get) for c, m in self.fitted["codes"].items()}

    def inverse(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        """Codes back to levels (unknown / missing codes -> NULL)."""
        stats, rep, out = self.fitted, {}, df
        for i, c in enumerate(cols or self.conf["cols"]):
            if stats.get("path"):
                t = self.level_table().where(F.col("column") == c).select(F.col("code").alias(f"_c{i}"),
                                                                          F.col("value").alias(f"_v{i}"))
                out = out.join(t, F.col(f"`{c}`") == F.col(f"_c{i}"), "left")
                rep[c] = F.col(f"_v{i}")
            else:
                inv = {str(code): v for v, code in stats["codes"].get(c, {}).items()}
                out, rep[c] = _lookup(out, c, inv, "string", f"_v{i}")
        return out.select(*ordered_columns(df, rep))


class Ordinal(StatEstimator):
    """Sorted-order codes; unseen -> ``unknown``; NULL -> ``missing``.
    (``StringIndexer`` orders by frequency, so it is not used.)"""
    model_class = OrdinalModel

    def __init__(self, cols: Sequence[str] = (), unknown: int | None = -1, missing: int | None = None,
                 max_levels: int = MAX_LEVELS):
        super().__init__(cols=list(cols), unknown=unknown, missing=missing, max_levels=max_levels)

    def compute(self, df, conf):
        rows, path = fit_levels(df, conf["cols"], max_levels=conf["max_levels"])
        if path:
            return {"path": path}
        return {"codes": _codes(rows, conf["cols"])}


class OneHotModel(StatModel):
    def apply(self, df, conf, stats):
        new = []
        for c in conf["cols"]:
            x = F.col(f"`{c}`").cast("string")
            for v in stats["levels"][c]:
                new.append(F.coalesce((x == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
            if conf["dummy_na"]:
                new.append(x.isNull().cast("int").alias(f"{c}_nan"))
        keep = [F.col(f"`{c}`") for c in df.columns if not (conf["drop_input"] and c in conf["cols"])]
        return df.select(*keep, *new)

    def output_columns(self) -> list[str]:
        conf, stats = self.conf, self.fitted
        out = []
        for c in conf["cols"]:
            out += [f"{c}_{v}" for v in stats["levels"][c]] + ([f"{c}_nan"] if conf["dummy_na"] else [])
        return out


class OneHot(StatEstimator):
    """One 0/1 column per training level; unseen -> all zeros;
    ``dummy_na`` adds a ``{col}_nan`` indicator."""
    model_class = OneHotModel

    def __init__(self, cols: Sequence[str] = (), dummy_na: bool = False, drop_input: bool = True,
                 max_levels: int = 10000):
        super().__init__(cols=list(cols), dummy_na=dummy_na, drop_input=drop_input, max_levels=max_levels)

    def compute(self, df, conf):
        rows, path = fit_levels(df, conf["cols"], max_levels=conf["max_levels"])
        if path:
            raise ValueError(f"one-hot over more than {conf['max_levels']} levels; use SparseOneHot")
        return {"levels": {c: sorted(r["value"] for r in rows if r["column"] == c and r["value"] is not None)
                           for c in conf["cols"]}}


class SparseOneHotModel(StatModel):
    """Adds one sparse 0/1 vector a column; ``VectorAssembler`` takes them."""

    def apply(self, df, conf, stats):
        names = {c: f"_code{i}" for i, c in enumerate(conf["cols"])}
        own = json.dumps({"cols": list(names.values()), "unknown": -1, "missing": -2, "max_levels": conf["max_levels"]})
        coded = OrdinalModel(config=own, stats=json.dumps(stats["codes"])).transform(df.withColumns({n: F.col(f"`{c}`") for c, n in names.items()}))
        # a code past the last one is no level at all: the encoder gives it zeros
        for c, n in names.items():
            size = stats["sizes"][c]
            absent = F.lit(size) if conf["dummy_na"] else F.lit(size + 1)
            coded = coded.withColumn(n, F.when(F.col(n) == -2, absent).when(F.col(n) == -1, F.lit(size + 1)).otherwise(F.col(n)).cast("double"))
        widths = [stats["sizes"][c] + conf["dummy_na"] for c in names]
        some = [(n, c, w) for (c, n), w in zip(names.items(), widths) if w]
        out = coded
        if some:
            largest = df.sparkSession.range(1).select(*[F.lit(float(w - 1)).alias(n) for n, _, w in some])
            encoder = OneHotEncoder(inputCols=[n for n, *_ in some], outputCols=[f"{c}{conf['suffix']}" for _, c, _ in some],
                                    dropLast=True, handleInvalid="keep").fit(largest)
            out = encoder.transform(coded)
        return out.drop(*names.values())

    def level_table(self) -> DataFrame:
        """(column, value, code): the place of every level in its vector."""
        conf, stats = self.conf, self.fitted
        names = {f"_code{i}": c for i, c in enumerate(conf["cols"])}
        own = json.dumps({"cols": list(names), "unknown": -1, "missing": -2, "max_levels": conf["max_levels"]})
        table = OrdinalModel(config=own, stats=json.dumps(stats["codes"])).level_table()
        column = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("column")]
        return table.select(column.alias("column"), "value", "code")


class SparseOneHot(StatEstimator):
    """D5/D6 for any number of levels: a sparse vector column ``col + suffix``
    for each column, as wide as its training levels in code-point order (and a
    last place for nulls with ``dummy_na``); unseen levels are all zeros. Codes
    come from ``fit_levels``, so levels past ``max_levels`` are a written table
    that is joined. Fitting on the union of several frames aligns them (H1)."""
    model_class = SparseOneHotModel

    def __init__(self, cols: Sequence[str] = (), dummy_na: bool = False, suffix: str = "_vec", max_levels: int = MAX_LEVELS):
        super().__init__(cols=list(cols), dummy_na=dummy_na, suffix=suffix, max_levels=max_levels)

    def compute(self, df, conf):
        names = {c: f"_code{i}" for i, c in enumerate(conf["cols"])}
        copies = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        codes = Ordinal(list(names.values()), unknown=-1, missing=-2, max_levels=conf["max_levels"]).fit(copies)
        sizes = {r["column"]: r["n"] for r in codes.level_table().groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"codes": codes.fitted, "sizes": {c: sizes.get(n, 0) for c, n in names.items()}}


def sigmoid_blend(n: float, mean: float, prior: float, min_samples_leaf: float, smoothing: float) -> float:
    s = 1.0 / (1.0 + math.exp(-(n - min_samples_leaf) / smoothing))
    return prior * (1 - s) + mean * s


class TargetModel(StatModel):
    def apply(self, df, conf, stats):
        prior = stats["prior"]
        if stats.get("path"):
            return self._apply_table(df, conf, stats)
        rep, out = {}, df
        for i, c in enumerate(conf["cols"]):
            out, hit = _lookup(out, c, stats["values"].get(c, {}), "double", f"_enc{i}")
            rep[c] = F.coalesce(hit, F.lit(prior))
        return out.select(*ordered_columns(df, rep))

    def _apply_table(self, df, conf, stats):
        table = df.sparkSession.read.parquet(stats["path"])
        prior = F.lit(stats["prior"])
        if conf["mode"] == "sigmoid":
            s = 1.0 / (1.0 + F.exp(-(F.col("n") - conf["min_samples_leaf"]) / conf["smoothing"]))
            enc = prior * (1 - s) + F.col("mean") * s
        else:
            enc = (F.col("n") * F.col("mean") + prior * conf["smoothing"]) / (F.col("n") + conf["smoothing"])
        out = df
        for i, c in enumerate(conf["cols"]):
            t = table.where((F.col("column") == c) & F.col("value").isNotNull()) \
                     .select(F.col("value").alias(f"_v{i}"), enc.alias(f"_e{i}"))
            out = out.join(t, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left")
            out = out.withColumn(c, F.coalesce(F.col(f"_e{i}"), prior)).drop(f"_v{i}", f"_e{i}")
        return out


class Target(StatEstimator):
    """Level -> smoothed mean of the target.

    ``mode='sigmoid'`` (default): s = 1 / (1 + exp(-(n - min_samples_leaf) /
    smoothing)), value = prior * (1 - s) + mean * s.
    ``mode='additive'``: (n * mean + smoothing * prior) / (n + smoothing), the
    rule of ``pyspark.ml.feature.TargetEncoder``.
    Missing and unseen levels get the prior. Statistics come from one job
    (the prior is recovered from the level table of the first column)."""
    model_class = TargetModel

    def __init__(self, cols: Sequence[str] = (), label: str = "label", mode: str = "sigmoid",
                 min_samples_leaf: float = 20.0, smoothing: float = 10.0, max_levels: int = MAX_LEVELS):
        super().__init__(cols=list(cols), label=label, mode=mode, min_samples_leaf=min_samples_leaf,
                         smoothing=smoothing, max_levels=max_levels)

    def compute(self, df, conf):
        cols, label = conf["cols"], conf["label"]
        rows, path = fit_levels(df, cols, label=label, max_levels=conf["max_levels"])
        if path:
            t = df.sparkSession.read.parquet(path).where(F.col("column") == cols[0])
            r = t.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("p")).first()
            return {"path": path, "prior": r["p"]}
        first = [r for r in rows if r["column"] == cols[0]]
        prior = sum(r["n"] * r["mean"] for r in first) / sum(r["n"] for r in first)
        values = {}
        for r in rows:
            if r["value"] is None:
                continue
            if conf["mode"] == "sigmoid":
                v = sigmoid_blend(r["n"], r["mean"], prior, conf["min_samples_leaf"], conf["smoothing"])
            else:
                v = (r["n"] * r["mean"] + conf["smoothing"] * prior) / (r["n"] + conf["smoothing"])
            values.setdefault(r["column"], {})[r["value"]] = v
        return {"values": values, "prior": prior}


def align_columns(frames: list[DataFrame], keep: Sequence[str], fill=0) -> list[DataFrame]:
    """H1: outer column alignment - every frame gets the union of the other
    columns (sorted by name), absent ones filled with ``fill``."""
    names = sorted({c for f in frames for c in f.columns if c not in keep})
    out = []
    for f in frames:
        have = set(f.columns)
        out.append(f.select(*[F.col(f"`{k}`") for k in keep],
                            *[(F.col(f"`{n}`") if n in have else F.lit(fill)).alias(n) for n in names]))
    return out


def rename_positional(df: DataFrame, keep: Sequence[str], prefix: str = "f") -> DataFrame:
    """Rename every non-kept column to f0, f1, ... in column order."""
    others = [c for c in df.columns if c not in keep]
    return df.select(*[F.col(f"`{k}`") for k in keep],
                     *[F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(others)])


def assert_no_unseen(model: OrdinalModel, df: DataFrame) -> None:
    """Strict ordinal encoding - raise if ``df`` holds a level the model
    never saw (one anti-join job per column set, only the offending levels
    reach the driver, at most 20)."""
    seen = model.level_table().select("column", "value")
    lv = long_values(df, model.conf["cols"]).where(F.col("value").isNotNull()).distinct()
    bad = lv.join(seen, ["column", "value"], "left_anti").limit(20).collect()
    if bad:
        raise ValueError("unseen levels: " + ", ".join(f"{r['column']}={r['value']}" for r in bad))
