"""Derived fixture tables shared by the queries (see FIXTURES.md §3).

``cases``  stands in for the wide clinical table: one row per order with
           nullable codes, an age-like band, a count string, numerics with
           missing values and a planted binary label.
``scores`` long evaluation table (case_id, fold, model, score, label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featflow.functions.parse import round2, round6
from featflow.operators.ranking import hash_rank
from featflow.session import ensure_checkpoint_dir
from featflow.sources.tables import read_table

CATEGORICAL = ["priority", "status", "segment", "nation", "region", "band", "count_str"]
NUMERIC = ["totalprice", "acctbal", "qty", "disc"]
KEY, LABEL, SPLIT = "case_id", "label", "split"

# Fixed values of the fixture definition.
PRIORITY_NOT_SPECIFIED = "4-NOT SPECIFIED"
PRICE_UNIT = 100000.0
PRICE_SCALE = 500000.0


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    lines = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_discount"])
             .groupBy("l_orderkey")  # partial (map-side) aggregation before the shuffle
             .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"),
                  # 6 decimals: a parallel average differs in its last bit between engines
                  round6(F.avg("l_discount")).alias("disc")))
    # nation (25 rows) and region (5 rows) have a fixed size: broadcasting is safe.
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    cust = customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey)
    base = (orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
                  .join(cust, orders.o_custkey == cust.c_custkey))
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    n_lines = F.coalesce(F.col("n_lines"), F.lit(0))
    band_idx = F.least(F.floor(price / PRICE_UNIT), F.lit(4)) + 1
    label_score = (F.lit(0.5) * price / PRICE_SCALE
                   + F.lit(0.5) * ((k * 7919 + 104729) % 1009) / 1009)
    return base.select(
        k.alias("case_id"),
        F.when(k % 5 == 0, "test").otherwise("train").alias("split"),
        F.when(F.col("o_orderpriority") == PRIORITY_NOT_SPECIFIED, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        F.when(k % 17 == 0, "unknown").otherwise(F.concat(F.lit("b"), band_idx.cast("string"))).alias("band"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
         .when(n_lines >= 6, F.lit("6회 이상"))
         .otherwise(F.concat(n_lines.cast("string"), F.lit("회"))).alias("count_str"),
        price.alias("totalprice"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("acctbal"),
        F.col("qty"), F.col("disc"),
        (label_score > 0.64).cast("int").alias("label"),
    )


def score_columns(c: DataFrame) -> DataFrame:
    """Closed-form model scores, rounded to 2 decimals so ties occur."""
    k = F.col("case_id")
    tp = F.col("totalprice")
    return c.select(
        "case_id", "label",
        round2(tp / 500000).alias("a"),
        round2(((k * 31 + 7) % 997) / 997).alias("b"),
        round2(tp * 6 / 5000000 + ((k * 7919 + 104729) % 1009) * 4 / 10090).alias("c"),
    )


def scores(spark: SparkSession, sf_dir: str, n_folds: int = 5, seed: int = 42,
           materialize: bool = True) -> DataFrame:
    """Long table (case_id, fold, model, score, label); fold is stratified:
    (rank by seeded hash within label - 1) mod n_folds.

    It stands for the stored long score table that training writes once, so
    it is materialised with a reliable checkpoint in the shared folder: the
    evaluation operators read it several times (their exact two-level prefix
    sums need two passes) without re-running the joins and the seeded rank."""
    c = cases(spark, sf_dir).select("case_id", "totalprice", "label")
    ranked = hash_rank(score_columns(c), "case_id", by=["label"], seed=seed, name="_r")
    wide = ranked.withColumn("fold", ((F.col("_r") - 1) % n_folds).cast("int")).drop("_r")
    out = (wide.unpivot(["case_id", "fold", "label"], ["a", "b", "c"], "model", "score")
               .select("case_id", "fold", "model", "score", "label"))
    if materialize:
        ensure_checkpoint_dir(spark)
        out = out.checkpoint(eager=True)
    return out
