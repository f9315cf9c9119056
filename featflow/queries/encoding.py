"""Categorical encoder queries (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featflow.functions.parse import round6
from featflow.operators.encode import OneHot, Ordinal, Target
from featflow.plans.fixtures import CATEGORICAL, KEY, LABEL, SPLIT, cases
from featflow.queries import query
from featflow.queries.sql import r6, with_cases

# The encoders are fitted on training rows without status 'P', so that level
# is unseen at fit time and shows the unseen-level rule on the other rows.
FIT_ROWS = "split = 'train' AND status <> 'P'"


def _fit_rows(df):
    return df.where((F.col(SPLIT) == "train") & (F.col("status") != "P"))


def _levels_sql(cols, where):
    parts = [f"SELECT '{c}' AS col, {c} AS value FROM cases WHERE {where} AND {c} IS NOT NULL" for c in cols]
    return ("lv AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS code FROM ("
            + " UNION ".join(parts) + "))")


def _code_join_sql(cols, unknown="-1", missing="NULL"):
    sel = ", ".join(f"CAST(CASE WHEN c.{x} IS NULL THEN {missing} ELSE coalesce(l{i}.code, {unknown}) END AS INTEGER) AS {x}"
                    for i, x in enumerate(cols))
    joins = " ".join(f"LEFT JOIN lv l{i} ON l{i}.col = '{x}' AND l{i}.value = c.{x}" for i, x in enumerate(cols))
    return sel, joins


_SEL, _JOINS = _code_join_sql(CATEGORICAL)


@query("encode_ordinal", with_cases(f"SELECT c.case_id, {_SEL} FROM cases c {_JOINS}",
                                    _levels_sql(CATEGORICAL, FIT_ROWS)))
def encode_ordinal(spark, sf_dir):
    """D1 (+H2): sorted codes fitted on training rows, unseen -> -1, NULL stays NULL."""
    df = cases(spark, sf_dir)
    model = Ordinal(CATEGORICAL, unknown=-1).fit(_fit_rows(df))
    return model.transform(df).select(KEY, *CATEGORICAL)


_D3 = ["segment", "count_str"]


@query("encode_label_inverse", with_cases("""
SELECT c.case_id, c.split,
  CAST(l1.code AS INTEGER) AS segment_code, CAST(l2.code AS INTEGER) AS count_code,
  l1.value AS segment_back, l2.value AS count_back, CAST(g.code AS INTEGER) AS segment_global
FROM cases c
LEFT JOIN own l1 ON l1.split = c.split AND l1.col = 'segment' AND l1.value = c.segment
LEFT JOIN own l2 ON l2.split = c.split AND l2.col = 'count_str' AND l2.value = c.count_str
LEFT JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT segment AS value FROM cases)) g
  ON g.value = c.segment""",
    """own AS (SELECT split, col, value, row_number() OVER (PARTITION BY split, col ORDER BY value) - 1 AS code FROM (
       SELECT DISTINCT split, 'segment' AS col, segment AS value FROM cases
       UNION SELECT DISTINCT split, 'count_str', count_str FROM cases WHERE count_str IS NOT NULL))"""))
def encode_label_inverse(spark, sf_dir):
    """D3: label codes refitted on each split separately (as one script does),
    decoded back with the fitted map, and the codes of one global fit."""
    df = cases(spark, sf_dir).select(KEY, SPLIT, "segment", "count_str")
    glob = Ordinal(["segment"], unknown=None).fit(df)
    parts = []
    for s in ("train", "test"):
        rows = df.where(F.col(SPLIT) == s)
        own = Ordinal(_D3, unknown=None).fit(rows)
        coded = own.transform(rows).select(KEY, SPLIT, F.col("segment").alias("segment_code"),
                                           F.col("count_str").alias("count_code"))
        back = own.inverse(coded.withColumn("segment", F.col("segment_code"))
                                .withColumn("count_str", F.col("count_code")))
        parts.append(back.withColumnRenamed("segment", "segment_back").withColumnRenamed("count_str", "count_back"))
    both = parts[0].unionByName(parts[1])
    # the global code is a literal-map lookup of the decoded level: no join back
    return glob.transform(both.withColumn("segment", F.col("segment_back"))) \
        .withColumnRenamed("segment", "segment_global")


_D4 = ["priority", "count_str", "band"]


@query("encode_codes", with_cases(
    "SELECT c.case_id, " + _code_join_sql(_D4, unknown="-1", missing="-1")[0] + " FROM cases c "
    + _code_join_sql(_D4)[1], _levels_sql(_D4, "TRUE")))
def encode_codes(spark, sf_dir):
    """Category codes over the whole table, missing -> -1."""
    df = cases(spark, sf_dir)
    return Ordinal(_D4, unknown=-1, missing=-1).fit(df).transform(df).select(KEY, *_D4)


_D5 = ["status", "segment"]
_D5_LEVELS = {"status": ["F", "O"], "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}


@query("encode_onehot", with_cases("SELECT case_id, " + ", ".join(
    f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS \"{c}_{v}\"" for c in _D5 for v in _D5_LEVELS[c])
    + " FROM cases"))
def encode_onehot(spark, sf_dir):
    """One column per training level; the unseen status 'P' -> all zeros."""
    df = cases(spark, sf_dir)
    m = OneHot(_D5).fit(_fit_rows(df))
    return m.transform(df.select(KEY, *_D5))


_D7 = ["segment", "nation", "band", "count_str"]


def _target_sql():
    parts = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, label FROM cases WHERE split = 'train'" for c in _D7)
    st = ("st AS (SELECT col, value, count(*) AS n, avg(label) AS mean FROM (" + parts + ") "
          "WHERE value IS NOT NULL GROUP BY col, value)")
    pr = "pr AS (SELECT avg(label) AS prior FROM cases WHERE split = 'train')"
    enc = ("enc AS (SELECT col, value, prior * (1 - 1 / (1 + exp(-(n - 20) / 10))) + mean * (1 / (1 + exp(-(n - 20) / 10))) AS v, "
           "(n * mean + 10 * prior) / (n + 10) AS v_add FROM st, pr)")
    sel = ", ".join(f"{r6(f'coalesce(e{i}.v, pr.prior)')} AS {c}" for i, c in enumerate(_D7))
    joins = " ".join(f"LEFT JOIN enc e{i} ON e{i}.col = '{c}' AND e{i}.value = c.{c}" for i, c in enumerate(_D7))
    body = (f"SELECT c.case_id, {sel}, {r6('coalesce(a.v_add, pr.prior)')} AS segment_additive "
            f"FROM cases c CROSS JOIN pr {joins} LEFT JOIN enc a ON a.col = 'segment' AND a.value = c.segment")
    return with_cases(body, st, pr, enc)


@query("encode_target", _target_sql())
def encode_target(spark, sf_dir):
    """Smoothed target means fitted on training rows; missing/unseen -> prior.
    Also the additive smoothing of ``pyspark.ml.feature.TargetEncoder``."""
    df = cases(spark, sf_dir).withColumn("segment_additive", F.col("segment"))
    train = df.where(F.col(SPLIT) == "train")
    sig = Target(_D7, label=LABEL).fit(train)
    add = Target(["segment_additive"], label=LABEL, mode="additive").fit(train)
    out = add.transform(sig.transform(df))  # one projection, no join
    return out.select(KEY, *[round6(c).alias(c) for c in _D7 + ["segment_additive"]])


# ------------------------------------------------------------ B25 / D6 / H1
from featflow.operators.encode import align_columns, rename_positional  # noqa: E402

_D6 = ["priority", "status"]
_D6_NAMES = sorted([f"priority_{v}" for v in ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "nan"]]
                   + [f"status_{v}" for v in ["F", "O", "P", "nan"]])


def _dummy_sql(name):
    col, level = name.split("_", 1)
    if level == "nan":
        return f"CAST({col} IS NULL AS INTEGER)"
    return f"CAST(coalesce({col} = '{level}', false) AS INTEGER)"


@query("onehot_align", with_cases("SELECT case_id, split, " + ", ".join(
    f"{_dummy_sql(n)} AS f{i}" for i, n in enumerate(_D6_NAMES)) + " FROM cases"))
def onehot_align(spark, sf_dir):
    """D6 + H1 + B25: dummies with a NaN column fitted on each split
    separately (as the reference's get_dummies does), outer-aligned with 0
    fill, then renamed f0..fn."""
    df = cases(spark, sf_dir).select(KEY, SPLIT, *_D6)
    parts = []
    for s in ("train", "test"):
        rows = df.where(F.col(SPLIT) == s)
        parts.append(OneHot(_D6, dummy_na=True).fit(rows).transform(rows))
    a, b = align_columns(parts, keep=[KEY, SPLIT])
    return rename_positional(a.unionByName(b), keep=[KEY, SPLIT])
