"""Ensembles over the long score table (key, fold, member, score, label).

Member weights are a table with one row per member (a handful), always
broadcast; blending is a grouped weighted sum per key - no pivot needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featflow.operators.evaluate import auc
from featflow.operators.joins import broadcast_if_small


def member_auc(scores: DataFrame, member: str = "model", by: Sequence[str] = ()) -> DataFrame:
    return auc(scores, [*by, member])


def blend(scores: DataFrame, weights: DataFrame, key: str = "case_id", member: str = "model",
          by: Sequence[str] = (), keep: Sequence[str] = ("label",), name: str = "score") -> DataFrame:
    """Sum of w_member * score per key (members without a weight contribute 0)."""
    w = broadcast_if_small(weights.select(*by, member, "w"))  # one row per (group, member)
    j = scores.join(w, [*by, member])
    return j.groupBy(key, *by, *keep).agg(F.sum(F.col("score") * F.col("w")).alias(name))


def mean_vote(scores: DataFrame, key: str = "case_id", keep: Sequence[str] = ("label",),
              name: str = "score") -> DataFrame:
    """Mean of the members' probabilities per key."""
    return scores.groupBy(key, *keep).agg(F.avg("score").alias(name))


def _ranked(aucs: DataFrame, member: str, by: Sequence[str]) -> DataFrame:
    # window over the tiny per-member AUC table only (members x groups rows)
    w = Window.partitionBy(*by).orderBy(F.col("auc").desc(), F.col(member).asc())
    return aucs.withColumn("rk", F.row_number().over(w))


def best_weights(aucs: DataFrame, member: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """Weight 1 on the best member (first on ties)."""
    return _ranked(aucs, member, by).where("rk = 1").select(*by, member, F.lit(1.0).alias("w"))


def topk_weights(aucs: DataFrame, k: int, member: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """The k best members, weights proportional to their AUC."""
    top = _ranked(aucs, member, by).where(F.col("rk") <= k)
    return top.select(*by, member, (F.col("auc") / F.sum("auc").over(Window.partitionBy(*by))).alias("w"))


def bonus_weights(aucs: DataFrame, bonus: float = 1.5, member: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """All members weighted by AUC, the best one multiplied by ``bonus``,
    renormalised."""
    r = _ranked(aucs, member, by).withColumn(
        "raw", F.when(F.col("rk") == 1, F.col("auc") * bonus).otherwise(F.col("auc")))
    return r.select(*by, member, (F.col("raw") / F.sum("raw").over(Window.partitionBy(*by))).alias("w"))


def proportional_weights(aucs: DataFrame, member: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """Start point of N6: weights proportional to each member's AUC."""
    return aucs.select(*by, member, (F.col("auc") / F.sum("auc").over(Window.partitionBy(*by))).alias("w"))


def simplex_grid(n_members: int, units: int) -> list[tuple[int, ...]]:
    """All integer weight vectors summing to ``units`` (weights = v / units)."""
    if n_members == 1:
        return [(units,)]
    out = []
    for i in range(units + 1):
        for rest in simplex_grid(n_members - 1, units - i):
            out.append((i, *rest))
    return out


def blend_search(wide: DataFrame, members: Sequence[str], label: str = "label", units: int = 10,
                 refine: int = 5, radius: int = 5) -> dict:
    """N6 re-aimed: maximise AUC over the weight simplex.

    Pass 1 scores every grid point with weights in steps of 1/units; pass 2
    refines around the best point in steps of 1/(units*refine). Each pass is
    ONE grouped job: rows are repeated per candidate (narrow explode), the
    blended score is aggregated to (candidate, score) counts map-side, and
    all AUCs come out together. Ties go to the lexicographically smallest
    weight vector."""
    def run(cands, scale):
        arr = F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in cands])
        ex = wide.select(label, *members, F.posexplode(arr).alias("cand", "wv"))
        s = None
        for i, m in enumerate(members):
            t = F.col("wv")[i] * F.col(m)
            s = t if s is None else s + t
        ex = ex.select("cand", label, (s / float(scale)).alias("score"))
        res = {r["cand"]: r["auc"] for r in auc(ex, ["cand"], label=label).collect()}  # <= len(cands) rows
        best = max(range(len(cands)), key=lambda i: (res.get(i) or -1.0, [-v for v in cands[i]]))
        return cands[best], res.get(best)

    c1, a1 = run(simplex_grid(len(members), units), units)
    fine = units * refine
    center = [v * refine for v in c1]
    cands = [c for c in simplex_grid(len(members), fine)
             if all(abs(v - m) <= radius for v, m in zip(c, center))]
    c2, a2 = run(cands, fine)
    return {"weights": [v / fine for v in c2], "units": list(c2), "scale": fine, "auc": a2,
            "coarse_weights": [v / units for v in c1], "coarse_auc": a1}
