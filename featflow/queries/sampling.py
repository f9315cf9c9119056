"""Sampling, rebalancing and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featflow.functions.parse import round6
from featflow.operators import sample as S
from featflow.plans.fixtures import KEY, LABEL, SPLIT, cases
from featflow.queries import query
from featflow.queries.sql import r6, with_cases

RANKED = ("rk AS (SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', case_id)), case_id) AS r, "
          "count(*) OVER (PARTITION BY label) AS n_c, min(n) OVER () AS n_min FROM "
          "(SELECT *, count(*) OVER (PARTITION BY label) AS n FROM cases WHERE split = 'train'))")


def _train(spark, sf_dir):
    return cases(spark, sf_dir).where(F.col(SPLIT) == "train").select(KEY, LABEL)


@query("undersample_half", with_cases(
    "SELECT case_id, label FROM rk WHERE n_c = n_min OR r <= least(n_c, CAST(floor(n_min / 0.5) AS BIGINT))", RANKED))
def undersample_half(spark, sf_dir):
    """All minority rows + 2x as many majority rows, seeded."""
    return S.undersample(_train(spark, sf_dir), KEY, LABEL, ratio=0.5, seed=42)


@query("undersample_11", with_cases(
    "SELECT case_id, label FROM rk WHERE n_c = n_min UNION ALL SELECT case_id, label FROM rk WHERE n_c > n_min AND r <= n_min",
    RANKED))
def undersample_11(spark, sf_dir):
    """1:1 undersampling as minority UNION sampled majority."""
    return S.undersample_union(_train(spark, sf_dir), KEY, LABEL, ratio=1.0, seed=42)


@query("split_stratified", with_cases(
    "SELECT case_id, label, CASE WHEN r <= floor((n_c * 2 + 10 * 0.5) // 10) THEN 'holdout' ELSE 'fit' END AS part FROM rk"
    .replace("floor((n_c * 2 + 10 * 0.5) // 10)", "(n_c * 2 + 5) // 10"), RANKED))
def split_stratified(spark, sf_dir):
    """Stratified 20 % hold-out."""
    return S.stratified_holdout(_train(spark, sf_dir), KEY, LABEL, test_size=0.2, seed=42)


@query("split_random", with_cases("""
SELECT case_id, label, CASE WHEN r <= (n * 2 + 5) // 10 THEN 'holdout' ELSE 'fit' END AS part, r <= 1000 AS in_sample
FROM (SELECT case_id, label, row_number() OVER (ORDER BY md5(concat_ws('|', '42', case_id)), case_id) AS r,
             count(*) OVER () AS n FROM cases WHERE split = 'train')"""))
def split_random(spark, sf_dir):
    """I6 + I8: unstratified 20 % hold-out and a 1 000-row simple random sample."""
    return S.random_holdout(_train(spark, sf_dir), KEY, test_size=0.2, seed=42, sample_n=1000)


@query("kfold_stratified", with_cases(
    "SELECT case_id, label, " + ", ".join(f"CAST((r - 1) % {k} AS INTEGER) AS fold{k}" for k in (3, 5, 7)) + " FROM rk", RANKED))
def kfold_stratified(spark, sf_dir):
    """Stratified, shuffled k-fold assignment for k = 3, 5, 7."""
    return S.stratified_folds(_train(spark, sf_dir), KEY, LABEL, k=[3, 5, 7], seed=42)


@query("class_weights", with_cases(f"""
SELECT case_id, label, CASE WHEN label = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w_explicit,
  {r6('n_all / (2 * n_c)')} AS w_balanced, {r6('CASE WHEN label = 1 THEN n_neg / n_c ELSE 1.0 END')} AS w_scale_pos
FROM (SELECT case_id, label, count(*) OVER (PARTITION BY label) AS n_c, count(*) OVER () AS n_all,
             sum(1 - label) OVER () AS n_neg FROM cases WHERE split = 'train')"""))
def class_weights(spark, sf_dir):
    """Explicit [1, 3], balanced and scale_pos_weight row weights."""
    df = _train(spark, sf_dir)
    df = S.class_weights(df, LABEL, "explicit", {0: 1.0, 1: 3.0}, name="w_explicit")
    df = S.class_weights(df, LABEL, "balanced", name="w_balanced")
    df = S.class_weights(df, LABEL, "scale_pos", name="w_scale_pos")
    return df.select(KEY, LABEL, "w_explicit", round6("w_balanced").alias("w_balanced"),
                     round6("w_scale_pos").alias("w_scale_pos"))


# ------------------------------------------------------------ I3 / I4
from featflow.operators import neighbors as NB  # noqa: E402
from featflow.sources.tables import read_table  # noqa: E402


def _emb(spark, sf_dir):
    """Binary target on the embeddings: label 0 is the (minority) positive class."""
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]) \
        .select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))


def _r6_list(x):
    return f"list_transform({x}, lambda z: floor(z * 1e6 + 0.5) / 1e6)"


def _sq(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


SMOTE_CTES = [
    "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label = 0 AS INTEGER) AS y FROM embeddings)",
    "cnt AS (SELECT y, count(*) AS n FROM e GROUP BY y)",
    "mi AS (SELECT y FROM cnt ORDER BY n, y LIMIT 1)",
    "pr AS (SELECT min(n) AS n_min, max(n) AS n_maj FROM cnt)",
    "mino AS (SELECT e.vec_id AS id, e.v FROM e JOIN mi USING (y))",
    "rk AS (SELECT id, v, row_number() OVER (ORDER BY md5(concat_ws('|', '42', id)), id) AS r FROM mino)",
    f"nn AS MATERIALIZED (SELECT * FROM (SELECT a.id AS qid, b.id AS nn_id, row_number() OVER (PARTITION BY a.id ORDER BY {_sq('a.v', 'b.v')}, b.id) AS nn_rank "
    "FROM mino a, mino b WHERE a.id <> b.id) WHERE nn_rank <= 5)",
    "sy AS (SELECT j, (j % n_min) + 1 AS r, CAST(CAST('0x' || substr(md5('42|' || j || '|nn'), 1, 8) AS BIGINT) % 5 + 1 AS INTEGER) AS nn_rank, "
    "CAST('0x' || substr(md5('42|' || j || '|gap'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS gap FROM pr, range(0, n_maj - n_min) t(j))",
    "syn AS MATERIALIZED (SELECT sy.j AS syn_id, rk.id AS base_id, nn.nn_id, sy.gap, list_transform(list_zip(rk.v, m2.v), lambda z: z[1] + sy.gap * (z[2] - z[1])) AS vector "
    "FROM sy JOIN rk USING (r) JOIN nn ON nn.qid = rk.id AND nn.nn_rank = sy.nn_rank JOIN mino m2 ON m2.id = nn.nn_id)",
]


@query("smote", "WITH " + ",\n".join(SMOTE_CTES) + f"""
SELECT syn_id, base_id, nn_id, {r6('gap')} AS gap, CAST(1 AS INTEGER) AS y, {_r6_list('vector')} AS vector FROM syn""")
def smote(spark, sf_dir):
    """SMOTE to 1:1 with k = 5 exact nearest minority neighbours."""
    s = NB.smote(_emb(spark, sf_dir), "vec_id", "embedding", "y", k=5, seed=42)
    return s.select("syn_id", "base_id", "nn_id", round6("gap").alias("gap"), F.col("y").cast("int").alias("y"),
                    F.transform("vector", lambda z: F.floor(z * 1e6 + 0.5) / 1e6).alias("vector"))


@query("tomek_links", "WITH " + ",\n".join(SMOTE_CTES + [
    "res AS MATERIALIZED (SELECT vec_id AS id, v, y FROM e UNION ALL SELECT -(syn_id + 1), vector, 1 FROM syn)",
    f"n1 AS MATERIALIZED (SELECT a.id AS qid, arg_min(b.id, ROW({_sq('a.v', 'b.v')}, b.id)) AS nn_id, any_value(a.y) AS ql "
    "FROM res a, res b WHERE a.id <> b.id GROUP BY a.id)"]) + """
SELECT a.qid AS id_a, a.nn_id AS id_b, a.ql AS label_a, b.ql AS label_b, a.ql <> b.ql AS is_link
FROM n1 a JOIN n1 b ON a.nn_id = b.qid AND b.nn_id = a.qid WHERE a.qid < a.nn_id""")
def tomek_links(spark, sf_dir):
    """I4: SMOTE, then Tomek links (mutual exact 1-NN of opposite class) over
    the resampled rows: every mutual nearest pair, ``is_link`` marking the
    opposite-class ones (both members of a link are what SMOTE+Tomek drops)."""
    emb = _emb(spark, sf_dir)
    syn = NB.smote(emb, "vec_id", "embedding", "y", k=5, seed=42)
    res = emb.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "y") \
        .unionByName(syn.select((-(F.col("syn_id") + 1)).alias("id"), F.col("vector").alias("v"),
                                F.col("y").cast("int").alias("y")))
    return NB.mutual_pairs(res, "id", "v", "y")
