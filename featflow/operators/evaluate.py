"""Exact, tie-aware evaluation over a long score table (K1-K8).

Scores are first aggregated to one row per (group, distinct score) with
positive / negative counts (map-side partial aggregation, so a hot score or
group never lands whole in one task); cumulative counts then come from the
two-level prefix sum of ``prefix_sums`` instead of an unpartitioned window.

AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)  (ties count half),
the same value as ``BinaryClassificationEvaluator(numBins=0)`` and
``roc_auc_score``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featflow.operators.joins import broadcast_if_small
from featflow.operators.ranking import join_null_safe, prefix_sums
from featflow.session import ensure_checkpoint_dir


def score_counts(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    y = F.col(label).cast("double")
    return df.groupBy(*by, score).agg(F.sum(y).alias("n_pos"), F.sum(1.0 - y).alias("n_neg"))


def held_counts(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """``score_counts`` written once with a reliable checkpoint: the prefix
    sums read their input for cuts, totals and rows, and the scored frame
    (a model's ``transform``, say) is to be computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return score_counts(df, by, score, label).checkpoint()


def auc_of_counts(counts: DataFrame, by: Sequence[str] = (), score: str = "score", n_buckets: int = 1024) -> DataFrame:
    """(by..., auc, n_pos, n_neg) from (by..., score, n_pos, n_neg) rows, one
    for each distinct score of a group."""
    by = list(by)
    c = prefix_sums(counts, by, score, ["n_neg"], n_buckets=n_buckets, inclusive=False)
    return (c.groupBy(*by).agg(
        F.sum(F.col("n_pos") * (F.col("n_neg_cum") * 2.0 + F.col("n_neg"))).alias("_num"),
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
        .select(*by, F.try_divide(F.col("_num"), F.col("n_pos") * F.col("n_neg") * 2.0).alias("auc"),
                F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg")))


def auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label",
        n_buckets: int = 1024) -> DataFrame:
    """(by..., auc, n_pos, n_neg) per group; ``df`` is read once."""
    return auc_of_counts(held_counts(df, list(by), score, label), by, score, n_buckets)


def roc_curve(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label",
              n_buckets: int = 1024) -> DataFrame:
    """One point per distinct threshold (all points kept):
    (by..., threshold, fpr, tpr) with tpr / fpr over scores >= threshold.
    ``df`` is read once."""
    by = list(by)
    g = held_counts(df, by, score, label).withColumn("_desc", -F.col(score))
    c = prefix_sums(g, by, "_desc", ["n_pos", "n_neg"], n_buckets=n_buckets, inclusive=True)
    tot = g.groupBy(*by).agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    if by:
        j = join_null_safe(c, tot, by)
    else:  # a single totals row: broadcast it on a constant key
        j = c.withColumn("_one", F.lit(1)).join(F.broadcast(tot.withColumn("_one", F.lit(1))), "_one")
    return j.select(*by, F.col(score).alias("threshold"),
                    F.try_divide(F.col("n_neg_cum"), F.col("N")).alias("fpr"),
                    F.try_divide(F.col("n_pos_cum"), F.col("P")).alias("tpr"))


def youden(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best threshold by J = tpr - fpr; on ties the highest threshold (the
    first point in descending-threshold order)."""
    by = list(by)
    j = curve.withColumn("j", F.col("tpr") - F.col("fpr"))
    key = F.struct(F.col("j"), F.col("threshold"))
    return (j.groupBy(*by).agg(F.max_by(F.struct("threshold", "j", "tpr", "fpr"), key).alias("b"))
             .select(*by, "b.threshold", "b.j", "b.tpr", "b.fpr"))


def apply_threshold(df: DataFrame, thresholds: DataFrame, by: Sequence[str], score: str = "score",
                    name: str = "pred") -> DataFrame:
    """``score >= threshold`` per group; the threshold table has one row per
    group and is broadcast if counted small."""
    return df.join(broadcast_if_small(thresholds.select(*by, "threshold")), list(by)) \
             .withColumn(name, (F.col(score) >= F.col("threshold")).cast("int"))


def classification_report(df: DataFrame, by: Sequence[str] = (), pred: str = "pred",
                          label: str = "label") -> DataFrame:
    """Per class precision / recall / F1 / support, plus accuracy, macro and
    weighted averages; 0/0 counts as 0. Long form (by..., row, precision,
    recall, f1, support)."""
    by = list(by)
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    cm = df.groupBy(*by).agg(
        F.sum(((y == 1) & (p == 1)).cast("bigint")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("bigint")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("bigint")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("bigint")).alias("tn"))

    def prf(tp, fp, fn):
        prec = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(prec * rec * 2.0, prec + rec), F.lit(0.0))
        return prec, rec, f1

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    def row(name, prec, rec, f1, sup):
        return F.struct(F.lit(name).alias("row"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.cast("double").alias("f1"),
                        sup.cast("bigint").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", none, none, F.try_divide((tp + tn).cast("double"), n), n),
        row("macro avg", (p0 + p1) / 2.0, (r0 + r1) / 2.0, (f0 + f1) / 2.0, n),
        row("weighted avg", F.try_divide(p0 * s0 + p1 * s1, n), F.try_divide(r0 * s0 + r1 * s1, n),
            F.try_divide(f0 * s0 + f1 * s1, n), n),
    )
    return cm.select(*by, F.inline(rows))
