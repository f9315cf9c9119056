"""Evaluation queries (K*, A5, A8, J12/K8) over the ``scores`` fixture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featflow.functions.parse import round6
from featflow.operators import evaluate as E
from featflow.plans.fixtures import scores
from featflow.queries import query
from featflow.queries.sql import auc_sql, r6, with_cases


def _sc(q):
    return with_cases(q, scores=True)


@query("roc_auc", _sc(f"SELECT model, {r6('auc')} AS auc, n_pos, n_neg FROM {auc_sql('scores', ['model'])}"))
def roc_auc(spark, sf_dir):
    a = E.auc(scores(spark, sf_dir), ["model"])
    return a.select("model", round6("auc").alias("auc"), "n_pos", "n_neg")


ROC_SQL = """roc AS (
  SELECT model, score AS threshold,
    sum(n_neg) OVER (PARTITION BY model ORDER BY score DESC) / sum(n_neg) OVER (PARTITION BY model) AS fpr,
    sum(n_pos) OVER (PARTITION BY model ORDER BY score DESC) / sum(n_pos) OVER (PARTITION BY model) AS tpr
  FROM (SELECT model, score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM scores GROUP BY model, score))"""


@query("roc_curve", with_cases(f"SELECT model, threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM roc",
                               ROC_SQL, scores=True))
def roc_curve(spark, sf_dir):
    c = E.roc_curve(scores(spark, sf_dir), ["model"])
    return c.select("model", "threshold", round6("fpr").alias("fpr"), round6("tpr").alias("tpr"))


YOUDEN_SQL = """yd AS (SELECT model, threshold, tpr - fpr AS j, tpr, fpr FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY tpr - fpr DESC, threshold DESC) AS rk FROM roc) WHERE rk = 1)"""


@query("youden", with_cases(f"SELECT model, threshold, {r6('j')} AS j, {r6('tpr')} AS tpr, {r6('fpr')} AS fpr FROM yd",
                            ROC_SQL, YOUDEN_SQL, scores=True))
def youden(spark, sf_dir):
    y = E.youden(E.roc_curve(scores(spark, sf_dir), ["model"]), ["model"])
    return y.select("model", "threshold", *[round6(c).alias(c) for c in ("j", "tpr", "fpr")])


@query("threshold_apply", with_cases("""
SELECT s.case_id, s.model, s.score AS probability, CAST(s.score >= yd.threshold AS INTEGER) AS class
FROM scores s JOIN yd USING (model)""", ROC_SQL, YOUDEN_SQL, scores=True))
def threshold_apply(spark, sf_dir):
    """K3 + A5: the Youden threshold of each model applied with >=; the
    submission frame (key, probability, class)."""
    sc = scores(spark, sf_dir)
    th = E.youden(E.roc_curve(sc, ["model"]), ["model"])
    out = E.apply_threshold(sc, th, ["model"], name="class")
    return out.select("case_id", "model", F.col("score").alias("probability"), "class")


CM_SQL = """cm AS (
  SELECT model,
    CAST(sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM scores GROUP BY model)"""
PRF_SQL = """prf AS (
  SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1,
    tn + fp AS s0, tp + fn AS s1, tp + tn + fp + fn AS n
  FROM (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
               coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1 FROM cm))"""


@query("classification_report", with_cases("""
SELECT model, row, """ + ", ".join(f"{r6(c)} AS {c}" for c in ("precision", "recall", "f1")) + """, support FROM (
  SELECT model, '0' AS row, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM prf
  UNION ALL SELECT model, '1', p1, r1, f1, s1 FROM prf
  UNION ALL SELECT model, 'accuracy', NULL, NULL, (tp + tn) / n, n FROM prf
  UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM prf
  UNION ALL SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n
  FROM prf)""", CM_SQL, PRF_SQL, scores=True))
def classification_report(spark, sf_dir):
    """K4/K5: per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages at threshold 0.5, per model."""
    sc = scores(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    r = E.classification_report(sc, ["model"])
    return r.select("model", "row", *[round6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


FOLD_AUC_SQL = "fa AS " + auc_sql("scores", ["model", "fold"])


@query("auc_by_group", with_cases(f"""
SELECT model, fold, {r6('auc')} AS auc, n_pos, n_neg FROM fa
UNION ALL SELECT model, -1, {r6('auc')}, n_pos, n_neg FROM {auc_sql('scores', ['model'])}""", FOLD_AUC_SQL, scores=True))
def auc_by_group(spark, sf_dir):
    """K7: AUC per (model, fold), and per model over all out-of-fold rows (fold -1)."""
    sc = scores(spark, sf_dir)
    per = E.auc(sc, ["model", "fold"])
    allf = E.auc(sc, ["model"]).withColumn("fold", F.lit(-1))
    return per.unionByName(allf).select("model", F.col("fold").cast("int").alias("fold"),
                                        round6("auc").alias("auc"), "n_pos", "n_neg")


@query("cv_summary", with_cases(f"""
SELECT fa.model, {r6('avg(fa.auc)')} AS auc_mean, {r6('stddev_pop(fa.auc)')} AS auc_std,
  {r6('avg(ac.acc)')} AS acc_mean, {r6('stddev_pop(ac.acc)')} AS acc_std, CAST(count(*) AS BIGINT) AS n_folds
FROM fa JOIN (SELECT model, fold, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS acc
              FROM scores GROUP BY model, fold) ac USING (model, fold)
GROUP BY fa.model""", FOLD_AUC_SQL, scores=True))
def cv_summary(spark, sf_dir):
    """K6: mean and population sd over folds of AUC and accuracy."""
    sc = scores(spark, sf_dir)
    per = E.auc(sc, ["model", "fold"])
    acc = sc.groupBy("model", "fold").agg(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("acc"))
    j = per.join(acc, ["model", "fold"])  # <= models x folds rows each
    return j.groupBy("model").agg(round6(F.avg("auc")).alias("auc_mean"), round6(F.stddev_pop("auc")).alias("auc_std"),
                                  round6(F.avg("acc")).alias("acc_mean"), round6(F.stddev_pop("acc")).alias("acc_std"),
                                  F.count(F.lit(1)).alias("n_folds"))


@query("fold_report", with_cases(f"""
SELECT model, fold, 'auc' AS metric, {r6('auc')} AS value FROM fa
UNION ALL SELECT model, fold, 'n_rows', CAST(count(*) AS DOUBLE) FROM scores GROUP BY model, fold
UNION ALL SELECT model, fold, 'positive_rate', {r6('avg(label)')} FROM scores GROUP BY model, fold""",
    FOLD_AUC_SQL, scores=True))
def fold_report(spark, sf_dir):
    """Per-fold metrics table (model, fold, metric, value)."""
    sc = scores(spark, sf_dir)
    a = E.auc(sc, ["model", "fold"]).select("model", "fold", F.lit("auc").alias("metric"), round6("auc").alias("value"))
    b = sc.groupBy("model", "fold").agg(F.count(F.lit(1)).cast("double").alias("n_rows"),
                                        round6(F.avg("label")).alias("positive_rate")) \
        .unpivot(["model", "fold"], ["n_rows", "positive_rate"], "metric", "value")
    return a.unionByName(b)


@query("cv_results", with_cases(f"""
SELECT model AS candidate, """ + ", ".join(f"{r6(f'max(CASE WHEN fold = {k} THEN auc END)')} AS split{k}_auc" for k in range(5)) + f""",
  {r6('avg(auc)')} AS mean_auc, {r6('stddev_pop(auc)')} AS std_auc,
  CAST(rank() OVER (ORDER BY {r6('avg(auc)')} DESC) AS INTEGER) AS rank_auc,
  CAST(max_by(fold, auc) AS INTEGER) AS best_split
FROM fa GROUP BY model""", FOLD_AUC_SQL, scores=True))
def cv_results(spark, sf_dir):
    """Search-result table - one row per candidate with its split
    scores, mean, population sd, rank and best split."""
    per = E.auc(scores(spark, sf_dir), ["model", "fold"])  # candidates x folds rows
    wide = per.groupBy("model").agg(
        *[round6(F.max(F.when(F.col("fold") == k, F.col("auc")))).alias(f"split{k}_auc") for k in range(5)],
        round6(F.avg("auc")).alias("mean_auc"), round6(F.stddev_pop("auc")).alias("std_auc"),
        F.max_by("fold", "auc").cast("int").alias("best_split"))
    return wide.select(F.col("model").alias("candidate"), *[f"split{k}_auc" for k in range(5)], "mean_auc", "std_auc",
                       F.rank().over(Window.orderBy(F.col("mean_auc").desc())).cast("int").alias("rank_auc"),
                       "best_split")
