"""Feature weighting by a (feature x procedure) weight table.

The weight table is a small configuration table (one row per feature, one
column per procedure). Fixed-procedure weights become literal multipliers
in one projection; row-wise weights join each row's procedure to the table
pivoted to one row per procedure (a size-checked broadcast hash join, no
shuffle of the big side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from featflow.operators.joins import broadcast_if_small


class WeightTable:
    def __init__(self, rows: Sequence[Mapping], feature: str = "feature"):
        self.feature = feature
        self.rows = [dict(r) for r in rows]
        self.procedures = [k for k in self.rows[0] if k != feature] if self.rows else []

    @classmethod
    def from_frame(cls, df: DataFrame, feature: str = "feature", max_rows: int = 100000) -> WeightTable:
        rows = df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError("weight table too large for a configuration table")
        return cls([r.asDict() for r in rows], feature)

    def to_dict(self) -> dict:
        """{procedure: {feature: weight}}."""
        return {p: {r[self.feature]: r[p] for r in self.rows} for p in self.procedures}

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = f"`{self.feature}` string, " + ", ".join(f"`{p}` double" for p in self.procedures)
        return spark.createDataFrame([tuple([r[self.feature]] + [float(r[p]) for p in self.procedures])
                                      for r in self.rows], schema)

    def long(self, spark: SparkSession) -> DataFrame:
        """W1 in long form: (feature, procedure, weight)."""
        return self.frame(spark).unpivot([self.feature], self.procedures, "procedure", "weight")

    def matched(self, columns: Sequence[str]) -> list[str]:
        """Features present in both the table and the frame."""
        return [r[self.feature] for r in self.rows if r[self.feature] in set(columns)]

    def unmatched(self, columns: Sequence[str]) -> list[str]:
        return [r[self.feature] for r in self.rows if r[self.feature] not in set(columns)]

    def product(self) -> dict:
        """Per feature, the product of its weights over all procedures."""
        out = {}
        for r in self.rows:
            p = 1.0
            for proc in self.procedures:
                p *= float(r[proc])
            out[r[self.feature]] = p
        return out

    def composite(self, pairs: Mapping[str, tuple[str, str]], unknown: float = 3.0) -> WeightTable:
        """Composite procedures as the mean of two procedure columns; ``Unknown`` fixed."""
        rows = []
        for r in self.rows:
            nr = {self.feature: r[self.feature]}
            for name, (a, b) in pairs.items():
                nr[name] = (float(r[a]) + float(r[b])) / 2.0
            nr["Unknown"] = float(unknown)
            rows.append(nr)
        return WeightTable(rows, self.feature)


def _numeric(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}


def weight_fixed(df: DataFrame, weights: Mapping[str, float], skip_non_numeric: bool = True) -> DataFrame:
    """Multiply each matched column by its literal weight (one projection);
    unmatched columns untouched, non-numeric columns skipped."""
    num = _numeric(df)
    rep = {c: F.col(f"`{c}`") * F.lit(float(w)) for c, w in weights.items()
           if c in df.columns and (c in num or not skip_non_numeric)}
    return df.withColumns(rep)


def weight_by_key(df: DataFrame, table: WeightTable, key: str, fallback: str = "Unknown",
                  zero_marker: str | None = "DI", zero_unless: str | None = "IUI",
                  leave_null_key: bool = False) -> DataFrame:
    """Row-wise weights chosen by the row's procedure ``key``; procedures
    missing from the table use the ``fallback`` column; features whose name
    holds ``zero_marker`` get weight 0 unless the procedure is ``zero_unless``.
    In a text column the cells that read as a number are weighted (and stay
    text), the others are left alone; columns of other types are skipped.
    ``leave_null_key``: rows without a procedure keep their values (W7)."""
    spark = df.sparkSession
    num = _numeric(df)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != key}
    feats = [f for f in table.matched(df.columns) if f in num | text]
    if not feats:
        return df
    by_proc = (table.long(spark).where(F.col(table.feature).isin(feats))
               .groupBy("procedure").pivot(table.feature, feats).agg(F.first("weight")))
    by_proc = by_proc.select(F.col("procedure").alias("_proc"), *[F.col(f).alias(f"_w_{f}") for f in feats])
    fb = {r[table.feature]: float(r[fallback]) for r in table.rows}
    joined = df.join(broadcast_if_small(by_proc, known_rows=len(table.procedures)),
                     df[key] == F.col("_proc"), "left")
    rep = {}
    for f in feats:
        w = F.coalesce(F.col(f"_w_{f}"), F.lit(fb[f]))
        if zero_marker and zero_marker in f:
            w = F.when(F.col(key) == F.lit(zero_unless), w).otherwise(F.lit(0.0))
        if leave_null_key:
            w = F.when(F.col(key).isNull(), F.lit(1.0)).otherwise(w)
        if f in text:
            x = F.col(f"`{f}`").try_cast("double")
            rep[f] = F.when(x.isNotNull(), (x * w).cast("string")).otherwise(F.col(f"`{f}`"))
        else:
            rep[f] = F.col(f"`{f}`") * w
    return joined.withColumns(rep).drop("_proc", *[f"_w_{f}" for f in feats])
