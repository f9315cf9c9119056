"""Profiling and statistics queries (F*)."""

from __future__ import annotations

from featflow.operators import stats
from featflow.plans.fixtures import cases
from featflow.queries import query
from featflow.queries.sql import with_cases

Q_RATE = with_cases("""
SELECT band, count(*) AS n, floor(avg(label) * 1e6 + 0.5) / 1e6 AS rate FROM cases GROUP BY band
""")


@query("rate_by_group", Q_RATE)
def rate_by_group(spark, sf_dir):
    return stats.rate_by_group(cases(spark, sf_dir), "band")


# ---------------------------------------------------------------------------
from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from featflow.functions.parse import parse_count, round6  # noqa: E402
from featflow.plans.fixtures import CATEGORICAL, KEY, LABEL, NUMERIC, scores  # noqa: E402
from featflow.queries.sql import r6  # noqa: E402

VC_COLS = ["split"] + CATEGORICAL + ["label"]


@query("value_counts", with_cases("SELECT col AS column_name, value, count(*) AS n FROM ("
                                  + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM cases" for c in VC_COLS)
                                  + ") GROUP BY col, value"))
def value_counts(spark, sf_dir):
    """value counts of every non-key column (one job over the unpivoted table)."""
    vc = stats.value_counts(cases(spark, sf_dir), VC_COLS)
    return vc.withColumnRenamed("column", "column_name")


ALL_COLS = ["case_id", "split"] + CATEGORICAL + NUMERIC + ["label"]


@query("null_counts", with_cases("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM cases" for c in ALL_COLS) + ")"))
def null_counts(spark, sf_dir):
    """NULLs per column in one pass."""
    return stats.null_counts(cases(spark, sf_dir), ALL_COLS).withColumnRenamed("column", "column_name")


@query("distinct_counts", with_cases("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM cases" for c in ALL_COLS) + ")"))
def distinct_counts(spark, sf_dir):
    """distinct values per column (exact; HLL sketches by parameter)."""
    return stats.distinct_counts(cases(spark, sf_dir), ALL_COLS).withColumnRenamed("column", "column_name")


@query("class_balance", with_cases("""
SELECT label, count(*) AS n, floor(count(*) / sum(count(*)) OVER () * 1e6 + 0.5) / 1e6 AS share,
  CAST(14 AS BIGINT) AS n_columns FROM cases GROUP BY label"""))
def class_balance(spark, sf_dir):
    """Class distribution and table shape."""
    return stats.class_balance(cases(spark, sf_dir), LABEL)


CORR_COLS = NUMERIC + ["label_f", "const"]
CORR_CTE = "cc AS (SELECT *, CAST(label AS DOUBLE) AS label_f, 1.0::DOUBLE AS const FROM cases)"


def _corr_sql(a, b):
    return (f"covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
            f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")


@query("corr_matrix", with_cases("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r6(_corr_sql(a, b))} AS corr FROM cc" for a in CORR_COLS for b in CORR_COLS) + ")",
    CORR_CTE))
def corr_matrix(spark, sf_dir):
    """Pearson matrix (pairwise-complete rows; constant column -> NULL)."""
    df = cases(spark, sf_dir).withColumn("label_f", F.col(LABEL).cast("double")).withColumn("const", F.lit(1.0))
    return stats.corr_long(df, CORR_COLS).select("a", "b", round6("corr").alias("corr"))


# leak-screen candidates: the fixture's numerics plus two echoes of the target
# and one all-NULL column (skipped by the screen)
LEAK_EXPR = {"label_echo": "label * 0.9 + (case_id % 10) / 100.0",
             "price_echo": "totalprice / 500000 + label",
             "empty_col": "CAST(NULL AS DOUBLE)"}
LEAK_COLS = NUMERIC + list(LEAK_EXPR)


@query("leak_screen", with_cases(f"""
SELECT feature, {r6('corr')} AS corr, CAST(row_number() OVER (ORDER BY abs(corr) DESC, feature) AS INTEGER) AS rank FROM (
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_corr_sql(f'coalesce({c}, 0)', 'CAST(label AS DOUBLE)')} AS corr, count({c}) AS n FROM lk"
    for c in LEAK_COLS) + ") WHERE n > 0 AND abs(corr) > 0.7 QUALIFY rank <= 10",
    "lk AS (SELECT *, " + ", ".join(f"{e.replace('100.0', '100.0::DOUBLE').replace('0.9', '0.9::DOUBLE')} AS {n}"
                                    for n, e in LEAK_EXPR.items()) + " FROM cases)"))
def leak_screen(spark, sf_dir):
    """target-correlation leak screen."""
    df = cases(spark, sf_dir).withColumns({n: F.expr(e) for n, e in LEAK_EXPR.items()})
    return stats.leak_screen(df, LEAK_COLS, LABEL).select("feature", round6("corr").alias("corr"), "rank")


@query("describe_scores", with_cases(f"""
SELECT model, 'score' AS "column", count(score) AS count, {r6('avg(score)')} AS mean, {r6('stddev_samp(score)')} AS std,
  min(score) AS min, {r6('quantile_cont(score, 0.25)')} AS p25, {r6('quantile_cont(score, 0.5)')} AS p50,
  {r6('quantile_cont(score, 0.75)')} AS p75, max(score) AS max FROM scores GROUP BY model""", scores=True))
def describe_scores(spark, sf_dir):
    """describe() of each model's scores."""
    d = stats.describe(scores(spark, sf_dir), ["score"], by=["model"])
    return d.select("model", "column", "count", *[round6(c).alias(c) for c in ("mean", "std")], "min",
                    *[round6(c).alias(c) for c in ("p25", "p50", "p75")], "max")


# ------------------------------------------------------------ importances
# 30 features: the fixture's measures and codes, an exact copy of totalprice
# (a tie), and pseudo-random hashed columns of the key.
IMP_BASE = {
    "totalprice": "totalprice", "totalprice_copy": "totalprice", "acctbal": "acctbal", "qty": "qty", "disc": "disc",
    "status_f": "CAST(status = 'F' AS DOUBLE)", "urgent": "CAST(priority = '1-URGENT' AS DOUBLE)",
    "band_unknown": "CAST(band = 'unknown' AS DOUBLE)", "m7": "CAST(case_id % 7 AS DOUBLE)",
    "m11": "CAST(case_id % 11 AS DOUBLE)", "seg_auto": "CAST(segment = 'AUTOMOBILE' AS DOUBLE)",
    "asia": "CAST(region = 'ASIA' AS DOUBLE)",
}
IMP_HASHED = {f"h{p}": f"CAST((case_id * {p} + 11) % 97 AS DOUBLE)" for p in
              (3, 5, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73)}
IMP_EXPR = {**IMP_BASE, **IMP_HASHED}
IMP_SQL = ("imp AS (SELECT feature, floor(raw / sum(raw) OVER () * 1e12 + 0.5) / 1e12 AS importance FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, coalesce(abs({_corr_sql(f'coalesce({n}, 0)', 'CAST(label AS DOUBLE)')}), 0) AS raw FROM fx"
    for n in IMP_EXPR) + "))")
FX_SQL = "fx AS (SELECT label, " + ", ".join(f"{e} AS {n}" for n, e in IMP_EXPR.items()) + " FROM cases)"


def _importance(spark, sf_dir, names=None):
    names = names or list(IMP_EXPR)
    df = cases(spark, sf_dir).select(LABEL, *[F.expr(IMP_EXPR[n]).alias(n) for n in names])
    imp = stats.importance(df, names, LABEL)
    # 12 decimals: parallel sums differ in the last bits, exact ties must stay ties
    return imp.select("feature", (F.floor(F.col("importance") * 1e12 + 0.5) / 1e12).alias("importance"))


@query("importance_topk", with_cases(
    f"SELECT feature, {r6('importance')} AS importance FROM imp ORDER BY importance DESC, feature LIMIT 5", FX_SQL, IMP_SQL))
def importance_topk(spark, sf_dir):
    """Five most important features, name breaking the tie."""
    return stats.top_k(_importance(spark, sf_dir), 5).select("feature", round6("importance").alias("importance"))


@query("select_cumulative", with_cases(f"""
SELECT feature, {r6('norm')} AS norm, {r6('cum')} AS cum, rank FROM (
  SELECT *, sum(CASE WHEN cum <= 0.8 THEN 1 ELSE 0 END) OVER () AS n_pass FROM (
    SELECT feature, importance / sum(importance) OVER () AS norm,
      sum(importance / sum(importance) OVER ()) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cum,
      row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp))
WHERE CASE WHEN n_pass >= 10 THEN cum <= 0.8 ELSE rank <= 10 END""".replace(
    "sum(importance / sum(importance) OVER ()) OVER", "sum(norm0) OVER").replace(
    "FROM imp))", "FROM (SELECT *, importance / sum(importance) OVER () AS norm0 FROM imp)))"), FX_SQL, IMP_SQL))
def select_cumulative(spark, sf_dir):
    """Cumulative-share feature selection (<= 0.8, at least 10)."""
    s = stats.select_cumulative(_importance(spark, sf_dir), 0.8, 10)
    return s.select("feature", round6("norm").alias("norm"), round6("cum").alias("cum"), F.col("rank").cast("bigint"))


@query("select_threshold", with_cases(
    f"SELECT feature, {r6('importance')} AS importance FROM imp WHERE importance >= 0.01", FX_SQL, IMP_SQL))
def select_threshold(spark, sf_dir):
    """Keep features with at least a 1 % share of importance."""
    imp = _importance(spark, sf_dir)
    return imp.where(F.col("importance") >= 0.01).select("feature", round6("importance").alias("importance"))


@query("select_median", with_cases(f"""
SELECT feature, {r6('importance')} AS importance, importance >= med AS keep_median, importance >= mu AS keep_mean
FROM imp, (SELECT quantile_cont(importance, 0.5) AS med, avg(importance) AS mu FROM imp) t""", FX_SQL, IMP_SQL))
def select_median(spark, sf_dir):
    """threshold = median (explicit) or mean (default) importance."""
    imp = _importance(spark, sf_dir)
    everything = Window.partitionBy()   # over the per-feature table only (one row per feature)
    j = imp.select("feature", "importance", F.percentile("importance", 0.5).over(everything).alias("med"),
                   F.avg("importance").over(everything).alias("mu"))
    return j.select("feature", round6("importance").alias("importance"),
                    (F.col("importance") >= F.col("med")).alias("keep_median"),
                    (F.col("importance") >= F.col("mu")).alias("keep_mean"))
