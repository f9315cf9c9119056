"""Imputation queries (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featflow.functions.parse import round6
from featflow.operators.encode import Ordinal
from featflow.operators.impute import ClassMeanImpute, Impute
from featflow.plans.fixtures import KEY, LABEL, SPLIT, cases
from featflow.queries import query
from featflow.queries.sql import r6, with_cases

NUM = ["acctbal", "qty", "disc"]


def _train(df):
    return df.where(F.col(SPLIT) == "train")


def _out(df, cols=NUM, extra=()):
    return df.select(KEY, *extra, *[round6(c).alias(c) for c in cols])


@query("impute_const", with_cases("""
SELECT case_id, coalesce(acctbal, 0) AS acctbal, coalesce(qty, 0) AS qty, coalesce(disc, 0) AS disc,
  coalesce(priority, '0') AS priority FROM cases"""))
def impute_const(spark, sf_dir):
    df = cases(spark, sf_dir).select(KEY, *NUM, "priority")
    m = Impute(NUM, strategy="constant", value=0.0).fit(df)
    return m.transform(df).na.fill({"priority": "0"})


def _fill_sql(stat, by=None):
    sel = ", ".join(f"{stat.format(c)} AS m_{c}" for c in NUM)
    if by:
        return (f"SELECT case_id, split, " + ", ".join(r6(f"coalesce(c.{c}, s.m_{c})") + f" AS {c}" for c in NUM)
                + f" FROM cases c JOIN (SELECT {by}, {sel} FROM cases GROUP BY {by}) s USING ({by})")
    return ("SELECT case_id, split, " + ", ".join(r6(f"coalesce(c.{c}, s.m_{c})") + f" AS {c}" for c in NUM)
            + f" FROM cases c, (SELECT {sel} FROM cases WHERE split = 'train') s")


@query("impute_mean", with_cases(_fill_sql("avg({})")))
def impute_mean(spark, sf_dir):
    df = cases(spark, sf_dir)
    m = Impute(NUM, strategy="mean").fit(_train(df))
    return _out(m.transform(df), extra=[SPLIT])


@query("impute_median", with_cases("""
SELECT case_id, split, """ + ", ".join(r6(f"coalesce(e.{c}, s.m_{c})") + f" AS {c}" for c in NUM + ["prio"]) + """
FROM (SELECT c.case_id, c.split, c.acctbal, c.qty, c.disc,
        CAST(CASE WHEN c.priority IS NULL THEN NULL ELSE coalesce(l.code, -1) END AS DOUBLE) AS prio
      FROM cases c LEFT JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
        FROM (SELECT DISTINCT priority AS value FROM cases WHERE split = 'train' AND priority IS NOT NULL)) l
      ON c.priority = l.value) e,
     (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUM) + """,
        quantile_cont(CAST(CASE WHEN c.priority IS NULL THEN NULL ELSE coalesce(l.code, -1) END AS DOUBLE), 0.5) AS m_prio
      FROM cases c LEFT JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
        FROM (SELECT DISTINCT priority AS value FROM cases WHERE split = 'train' AND priority IS NOT NULL)) l
      ON c.priority = l.value WHERE c.split = 'train') s"""))
def impute_median(spark, sf_dir):
    """Median imputation after ordinal encoding, train statistics."""
    df = cases(spark, sf_dir)
    enc = Ordinal(["priority"], unknown=-1, missing=None).fit(_train(df))
    coded = enc.transform(df).withColumn("prio", F.col("priority").cast("double"))
    m = Impute(NUM + ["prio"], strategy="median").fit(_train(coded))
    return _out(m.transform(coded), NUM + ["prio"], extra=[SPLIT])


@query("impute_median_split", with_cases(_fill_sql("quantile_cont({}, 0.5)", by="split")))
def impute_median_split(spark, sf_dir):
    """C4: each split filled with its OWN median (kept as a capability; it leaks)."""
    df = cases(spark, sf_dir)
    m = Impute(NUM, strategy="median", by=SPLIT).fit(df)
    return _out(m.transform(df), extra=[SPLIT])


@query("impute_mean_split", with_cases(_fill_sql("avg({})", by="split")))
def impute_mean_split(spark, sf_dir):
    """Each split filled with its own mean."""
    df = cases(spark, sf_dir)
    m = Impute(NUM, strategy="mean", by=SPLIT).fit(df)
    return _out(m.transform(df), extra=[SPLIT])


@query("impute_median_mode", with_cases("""
SELECT case_id, """ + ", ".join(r6(f"coalesce(c.{x}, s.m_{x})") + f" AS {x}" for x in NUM) + """,
  coalesce(c.priority, (SELECT priority FROM cases WHERE priority IS NOT NULL GROUP BY priority
                        ORDER BY count(*) DESC, priority LIMIT 1)) AS priority,
  coalesce(c.count_str, (SELECT count_str FROM cases WHERE count_str IS NOT NULL GROUP BY count_str
                         ORDER BY count(*) DESC, count_str LIMIT 1)) AS count_str
FROM cases c, (SELECT """ + ", ".join(f"quantile_cont({x}, 0.5) AS m_{x}" for x in NUM) + """ FROM cases) s"""))
def impute_median_mode(spark, sf_dir):
    """Whole table - numeric median, then categorical mode (lowest on ties)."""
    df = cases(spark, sf_dir).select(KEY, *NUM, "priority", "count_str")
    num = Impute(NUM, strategy="median").fit(df).transform(df)
    out = Impute(["priority", "count_str"], strategy="mode").fit(num).transform(num)
    return out.select(KEY, *[round6(c).alias(c) for c in NUM], "priority", "count_str")


@query("impute_class_mean", with_cases("""
SELECT case_id, split, """ + ", ".join(r6(x) + f" AS {x}" for x in NUM) + """, totalprice FROM (
  SELECT * FROM filled
  UNION ALL
  SELECT c.case_id, c.split, coalesce(c.acctbal, o.a), coalesce(c.qty, o.q), coalesce(c.disc, o.d), c.totalprice
  FROM cases c, (SELECT avg(acctbal) a, avg(qty) q, avg(disc) d FROM filled) o WHERE c.split = 'test')""",
    """cm AS (SELECT label, avg(acctbal) a, avg(qty) q, avg(disc) d FROM cases WHERE split = 'train' GROUP BY label)""",
    """filled AS (SELECT c.case_id, c.split, coalesce(c.acctbal, cm.a) AS acctbal, coalesce(c.qty, cm.q) AS qty,
       coalesce(c.disc, cm.d) AS disc, c.totalprice
     FROM cases c JOIN cm USING (label) WHERE c.split = 'train')"""))
def impute_class_mean(spark, sf_dir):
    """C7 (+F2, B30): training rows by class mean; test rows by the mean of
    the already-filled training column; only columns with training NULLs."""
    df = cases(spark, sf_dir)
    train, test = _train(df), df.where(F.col(SPLIT) == "test")
    m = ClassMeanImpute(NUM + ["totalprice"], label=LABEL).fit(train)
    both = m.transform_labeled(train).unionByName(m.transform(test))
    return both.select(KEY, SPLIT, *[round6(c).alias(c) for c in NUM], "totalprice")
