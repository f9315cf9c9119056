"""Ensemble, stacking-matrix and submission queries (N*, J7, J8 pivot, H3, A3/A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featflow.functions.parse import round6
from featflow.operators import ensemble as N
from featflow.operators.joins import broadcast_if_small
from featflow.operators.ranking import prefix_sums
from featflow.operators.scale import Robust
from featflow.plans.fixtures import cases, scores
from featflow.queries import query
from featflow.queries.sql import auc_sql, r6, with_cases

MAUC = "ma AS " + auc_sql("scores", ["model"])
RANKED = "mr AS (SELECT *, row_number() OVER (ORDER BY auc DESC, model) AS rk FROM ma)"


def _blend_sql(weights_cte):
    return with_cases(f"""
SELECT s.case_id, s.label, {r6('sum(s.score * w.w)')} AS score
FROM scores s JOIN wts w USING (model) GROUP BY s.case_id, s.label""", MAUC, RANKED, weights_cte, scores=True)


def _blend(spark, sf_dir, weights_fn):
    sc = scores(spark, sf_dir)
    w = weights_fn(N.member_auc(sc))
    return N.blend(sc, w).select("case_id", "label", round6("score").alias("score"))


@query("ensemble_mean", with_cases(f"SELECT case_id, label, {r6('avg(score)')} AS score FROM scores GROUP BY case_id, label",
                                   scores=True))
def ensemble_mean(spark, sf_dir):
    """Mean of the member models per row."""
    m = N.mean_vote(scores(spark, sf_dir))
    return m.select("case_id", "label", round6("score").alias("score"))


@query("soft_vote", with_cases(f"""
SELECT case_id, {r6('avg(score)')} AS probability, CAST(avg(score) >= 0.5 AS INTEGER) AS vote
FROM scores WHERE model IN ('a', 'c') GROUP BY case_id""", scores=True))
def soft_vote(spark, sf_dir):
    """Soft voting of two members (mean probability, class at 0.5)."""
    sc = scores(spark, sf_dir).where(F.col("model").isin("a", "c"))
    m = N.mean_vote(sc, keep=())
    return m.select("case_id", round6("score").alias("probability"), (F.col("score") >= 0.5).cast("int").alias("vote"))


@query("ensemble_best", _blend_sql("wts AS (SELECT model, 1.0 AS w FROM mr WHERE rk = 1)"))
def ensemble_best(spark, sf_dir):
    """The single best member by AUC."""
    return _blend(spark, sf_dir, N.best_weights)


@query("ensemble_topk", _blend_sql("wts AS (SELECT model, auc / sum(auc) OVER () AS w FROM mr WHERE rk <= 2)"))
def ensemble_topk(spark, sf_dir):
    """Top-2 members, weights proportional to AUC."""
    return _blend(spark, sf_dir, lambda a: N.topk_weights(a, 2))


@query("ensemble_bonus", _blend_sql(
    "wts AS (SELECT model, raw / sum(raw) OVER () AS w FROM (SELECT model, CASE WHEN rk = 1 THEN auc * 1.5 ELSE auc END AS raw FROM mr))"))
def ensemble_bonus(spark, sf_dir):
    """All members AUC-weighted, the best x 1.5, renormalised."""
    return _blend(spark, sf_dir, lambda a: N.bonus_weights(a, 1.5))


def _wide(sc):
    # one row per key with one column per member (explicit pivot values: no extra job)
    return sc.groupBy("case_id", "fold", "label").pivot("model", ["a", "b", "c"]).agg(F.first("score"))


WIDE_SQL = """wide AS (SELECT case_id, fold, label, max(CASE WHEN model = 'a' THEN score END) AS a,
  max(CASE WHEN model = 'b' THEN score END) AS b, max(CASE WHEN model = 'c' THEN score END) AS c
  FROM scores GROUP BY case_id, fold, label)"""


def _blend_search_sql():
    g1 = "g1 AS (SELECT i, j, 10 - i - j AS k FROM range(0, 11) t(i), range(0, 11) u(j) WHERE i + j <= 10)"
    cand = lambda g, scale: (f"(SELECT g.i, g.j, g.k, (g.i * w.a + g.j * w.b + g.k * w.c) / {scale} AS score, w.label "
                             f"FROM wide w, {g} g)")
    a1 = "a1 AS " + auc_sql(cand("g1", 10), ["i", "j", "k"])
    b1 = "b1 AS (SELECT i AS bi, j AS bj, k AS bk FROM a1 ORDER BY auc DESC, i, j, k LIMIT 1)"
    g2 = ("g2 AS (SELECT i, j, 50 - i - j AS k FROM range(0, 51) t(i), range(0, 51) u(j), b1 "
          "WHERE i + j <= 50 AND abs(i - 5 * bi) <= 5 AND abs(j - 5 * bj) <= 5 AND abs(50 - i - j - 5 * bk) <= 5)")
    a2 = "a2 AS " + auc_sql(cand("g2", 50), ["i", "j", "k"])
    body = f"""SELECT i / 50 AS w_a, j / 50 AS w_b, k / 50 AS w_c, {r6('auc')} AS auc FROM a2 ORDER BY auc DESC, i, j, k LIMIT 1"""
    return with_cases(body, WIDE_SQL, g1, a1, b1, g2, a2, scores=True)


@query("blend_search", _blend_search_sql())
def blend_search(spark, sf_dir):
    """N6 re-aimed: AUC-maximising blend weights on a refined simplex grid
    (replaces the general constrained optimiser)."""
    wide = _wide(scores(spark, sf_dir)).persist()
    try:
        res = N.blend_search(wide, ["a", "b", "c"], units=10, refine=5, radius=5)
    finally:
        wide.unpersist()
    w = res["weights"]
    # the result is a one-row table; AUC is recomputed by Spark from the data
    return spark.createDataFrame([(w[0], w[1], w[2], res["auc"])], "w_a double, w_b double, w_c double, auc double") \
        .select("w_a", "w_b", "w_c", round6("auc").alias("auc"))


@query("blend_apply", with_cases(f"""
SELECT s.case_id, s.fold, {r6('sum(s.score * fw.w)')} AS blend_fold, {r6('sum(s.score * gw.w)')} AS blend_global
FROM scores s
JOIN (SELECT model, fold, auc / sum(auc) OVER (PARTITION BY fold) AS w FROM {auc_sql('scores', ['model', 'fold'])}) fw USING (model, fold)
JOIN (SELECT model, auc / sum(auc) OVER () AS w FROM ma) gw USING (model)
GROUP BY s.case_id, s.fold""", MAUC, scores=True))
def blend_apply(spark, sf_dir):
    """Blend per fold (each fold's own member weights) and globally."""
    sc = scores(spark, sf_dir)
    fw = N.proportional_weights(N.member_auc(sc, by=["fold"]), by=["fold"]).withColumnRenamed("w", "wf")
    gw = N.proportional_weights(N.member_auc(sc)).withColumnRenamed("w", "wg")
    j = sc.join(broadcast_if_small(fw), ["model", "fold"]).join(broadcast_if_small(gw), "model")  # members x folds rows
    return j.groupBy("case_id", "fold").agg(round6(F.sum(F.col("score") * F.col("wf"))).alias("blend_fold"),
                                            round6(F.sum(F.col("score") * F.col("wg"))).alias("blend_global"))


@query("oof_assemble", with_cases("""
SELECT s.case_id, s.fold, s.model, s.score, c.label, c.segment, c.totalprice
FROM scores s JOIN cases c USING (case_id)""", scores=True))
def oof_assemble(spark, sf_dir):
    """Out-of-fold predictions joined back to their rows by key
    (never by position), target and features attached."""
    sc = scores(spark, sf_dir).drop("label")
    c = cases(spark, sf_dir).select("case_id", "label", "segment", "totalprice")
    return sc.join(c, "case_id").select("case_id", "fold", "model", "score", "label", "segment", "totalprice")


@query("stack_matrix", with_cases("""
SELECT case_id, fold, label, """ + ", ".join(
    f"{m} AS {m}, {r6(f'({m} - q.m_{m}) / CASE WHEN q.r_{m} = 0 THEN 1 ELSE q.r_{m} END')} AS {m}_robust" for m in "abc") + """
FROM wide, (SELECT """ + ", ".join(
    f"quantile_cont({m}, 0.5) AS m_{m}, quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) AS r_{m}" for m in "abc") + " FROM wide) q",
    WIDE_SQL, scores=True))
def stack_matrix(spark, sf_dir):
    """J8 (matrix part): long OOF table pivoted to one column per base model,
    then robust-scaled as the meta model's input."""
    wide = _wide(scores(spark, sf_dir))
    robust = Robust([f"{m}_robust" for m in "abc"]).fit(wide.select(*[F.col(m).alias(f"{m}_robust") for m in "abc"]))
    out = robust.transform(wide.select("case_id", "fold", "label", "a", "b", "c",
                                       *[F.col(m).alias(f"{m}_robust") for m in "abc"]))
    return out.select("case_id", "fold", "label", "a", "b", "c", *[round6(f"{m}_robust").alias(f"{m}_robust") for m in "abc"])


@query("submission", with_cases(f"""
SELECT printf('TEST_%05d', row_number() OVER (ORDER BY case_id) - 1) AS ID, case_id, {r6('p')} AS probability FROM (
  SELECT c.case_id, avg(s.score) AS p FROM cases c JOIN scores s USING (case_id) WHERE c.split = 'test' GROUP BY c.case_id)""",
    scores=True))
def submission(spark, sf_dir):
    """A3/A4: the held-out rows in key order, ids TEST_00000... by position,
    probability = mean of the members. The position is an exact global row
    number computed in two levels (no single-task window)."""
    sc = scores(spark, sf_dir)
    test = cases(spark, sf_dir).where(F.col("split") == "test").select("case_id")
    p = sc.join(test, "case_id").groupBy("case_id").agg(F.avg("score").alias("p")).withColumn("_one", F.lit(1))
    pos = prefix_sums(p, [], "case_id", ["_one"], inclusive=False)
    return pos.select(F.format_string("TEST_%05d", F.col("_one_cum")).alias("ID"), "case_id",
                      round6("p").alias("probability"))


@query("template_fill", with_cases(f"""
SELECT printf('TEST_%05d', row_number() OVER (ORDER BY case_id) - 1) AS ID, case_id, {r6('p')} AS probability FROM (
  SELECT c.case_id, avg(s.score) AS p FROM cases c JOIN scores s USING (case_id) WHERE c.split = 'test' GROUP BY c.case_id)""",
    scores=True))
def template_fill(spark, sf_dir):
    """A submission template with ids and empty scores is read from a
    CSV file in the shared folder, and the scores are filled in by key. The
    file holds the held-out keys, as the template beside a test file does."""
    from featflow.session import ensure_checkpoint_dir
    from featflow.sources.files import fill_template, read_csv, write_csv
    sc = scores(spark, sf_dir)
    test = cases(spark, sf_dir).where(F.col("split") == "test").select("case_id").withColumn("_one", F.lit(1))
    pos = prefix_sums(test, [], "case_id", ["_one"], inclusive=False)
    rows = pos.select(F.format_string("TEST_%05d", F.col("_one_cum")).alias("ID"), "case_id", F.lit(0.0).alias("probability"))
    path = f"{ensure_checkpoint_dir(spark)}/template-{uuid.uuid4().hex}"
    write_csv(rows, path, encoding="utf-8-sig")
    template = read_csv(spark, path, "ID string, case_id long, probability double", encoding="utf-8-sig")
    p = sc.groupBy("case_id").agg(round6(F.avg("score")).alias("probability"))
    return fill_template(template, p, "case_id")
