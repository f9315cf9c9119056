"""Feature-weighting queries (W*), applied to the ``cases`` rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from featflow.functions.parse import parse_count, round6
from featflow.operators.weights import WeightTable, weight_by_key, weight_fixed
from featflow.plans.fixtures import KEY, cases
from featflow.queries import query
from featflow.queries.sql import r6, with_cases

# The weight table of this fixture (feature x procedure, 0-5).
# Procedures are customer segments; MACHINERY and HOUSEHOLD are not listed
# and fall back to "Unknown"; "DI_count" is zero except for BUILDING (the
# procedure the DI rule keeps); "missing_feat" matches no column; "band" is
# categorical and is skipped.
WEIGHTS = [
    {"feature": "totalprice", "AUTOMOBILE": 2, "BUILDING": 3, "FURNITURE": 1, "Unknown": 1},
    {"feature": "acctbal", "AUTOMOBILE": 1, "BUILDING": 0, "FURNITURE": 2, "Unknown": 1},
    {"feature": "qty", "AUTOMOBILE": 3, "BUILDING": 2, "FURNITURE": 2, "Unknown": 2},
    {"feature": "disc", "AUTOMOBILE": 1, "BUILDING": 4, "FURNITURE": 5, "Unknown": 3},
    {"feature": "DI_count", "AUTOMOBILE": 4, "BUILDING": 5, "FURNITURE": 3, "Unknown": 2},
    {"feature": "missing_feat", "AUTOMOBILE": 5, "BUILDING": 5, "FURNITURE": 5, "Unknown": 5},
    {"feature": "band", "AUTOMOBILE": 2, "BUILDING": 2, "FURNITURE": 2, "Unknown": 2},
]
PROCS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "Unknown"]
FEATS = ["totalprice", "acctbal", "qty", "disc", "DI_count"]
ZERO_UNLESS = "BUILDING"


def _frame(spark, sf_dir):
    return cases(spark, sf_dir).select(KEY, "segment", "band", "totalprice", "acctbal", "qty", "disc",
                                       parse_count("count_str", as_float=True).alias("DI_count"))


def _values_sql():
    rows = ", ".join("('" + r["feature"] + "', " + ", ".join(f"{float(r[p])}::DOUBLE" for p in PROCS) + ")" for r in WEIGHTS)
    return f"wt(feature, {', '.join(PROCS)}) AS (VALUES {rows})"


FRAME_SQL = ("fr AS (SELECT case_id, segment, band, totalprice, acctbal, qty, disc, "
             "CAST(CASE WHEN count_str IS NULL THEN 0 WHEN contains(count_str, '회 이상') THEN 6 "
             "ELSE coalesce(TRY_CAST(nullif(regexp_extract(trim(count_str), '(\\d+)회?', 1), '') AS BIGINT), 0) END AS DOUBLE) AS DI_count "
             "FROM cases)")
LONG_SQL = "wl AS (" + " UNION ALL ".join(f"SELECT feature, '{p}' AS procedure, {p} AS weight FROM wt" for p in PROCS) + ")"


@query("weights_unpivot", with_cases("""
SELECT wl.feature, wl.procedure, wl.weight, count(c.case_id) AS n_rows
FROM wl LEFT JOIN (SELECT case_id, CASE WHEN segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN segment ELSE 'Unknown' END AS procedure
                   FROM cases) c ON c.procedure = wl.procedure
GROUP BY wl.feature, wl.procedure, wl.weight""", _values_sql(), LONG_SQL))
def weights_unpivot(spark, sf_dir):
    """The weight matrix in long form (feature, procedure, weight), with
    the number of rows each entry applies to (procedure fallback included)."""
    t = WeightTable(WEIGHTS)
    procs = t.procedures
    usage = (cases(spark, sf_dir)
             .select(F.when(F.col("segment").isin(*[p for p in procs if p != "Unknown"]), F.col("segment"))
                      .otherwise(F.lit("Unknown")).alias("procedure"))
             .groupBy("procedure").agg(F.count(F.lit(1)).alias("n_rows")))
    return (t.long(spark).join(F.broadcast(usage), "procedure", "left")   # <= len(procedures) rows
             .select("feature", "procedure", "weight", F.coalesce("n_rows", F.lit(0)).alias("n_rows")))


def _fixed_sql(weights):
    sel = ", ".join(f"{r6(f'{c} * {float(weights[c])}::DOUBLE')} AS {c}" if c in weights else f"{r6(c)} AS {c}" for c in FEATS)
    return with_cases(f"SELECT case_id, band, {sel} FROM fr", FRAME_SQL)


_IVF = {r["feature"]: r["AUTOMOBILE"] for r in WEIGHTS}


@query("weight_fixed", _fixed_sql({k: v for k, v in _IVF.items() if k in FEATS}))
def weight_fixed_q(spark, sf_dir):
    """Every row weighted by the AUTOMOBILE column; the categorical
    'band' and the unmatched 'missing_feat' are left alone."""
    df = _frame(spark, sf_dir)
    out = weight_fixed(df, WeightTable(WEIGHTS).to_dict()["AUTOMOBILE"])
    return out.select(KEY, "band", *[round6(c).alias(c) for c in FEATS])


_PROD = WeightTable(WEIGHTS).product()


@query("weight_product", _fixed_sql({k: v for k, v in _PROD.items() if k in FEATS}))
def weight_product(spark, sf_dir):
    """Product of a feature's weights over all procedures, applied to
    the features present in both the table and the frame."""
    df = _frame(spark, sf_dir)
    t = WeightTable(WEIGHTS)
    prods = t.product()
    out = weight_fixed(df, {f: prods[f] for f in t.matched(df.columns)})
    return out.select(KEY, "band", *[round6(c).alias(c) for c in FEATS])


def _rowwise_sql(table_cte, procs, fallback, zero=True, extra_sel="", extra_from=""):
    listed = ", ".join(f"'{p}'" for p in procs if p != fallback)
    sel = []
    for f in FEATS:
        w = f"coalesce(w.{f}, u.{f})"
        if zero and "DI" in f:
            w = f"CASE WHEN fr.segment = '{ZERO_UNLESS}' THEN {w} ELSE 0.0 END"
        sel.append(f"{r6(f'fr.{f} * {w}')} AS {f}")
    pivot = lambda where: ("(SELECT " + ", ".join(
        f"max(CASE WHEN feature = '{f}' THEN weight END) AS {f}" for f in FEATS) + f", procedure FROM {table_cte} WHERE {where} GROUP BY procedure)")
    return (f"SELECT fr.case_id, fr.segment, fr.band{extra_sel}, {', '.join(sel)} FROM fr {extra_from} "
            f"LEFT JOIN {pivot('procedure IN (' + listed + ')')} w ON w.procedure = fr.segment "
            f"CROSS JOIN {pivot(f"procedure = '{fallback}'")} u")


@query("weight_by_key", with_cases(_rowwise_sql("wl", PROCS, "Unknown"), _values_sql(), LONG_SQL, FRAME_SQL))
def weight_by_key_q(spark, sf_dir):
    """W4 (+H2): weights by each row's procedure (segment) with the Unknown
    fallback and the DI rule."""
    df = _frame(spark, sf_dir)
    out = weight_by_key(df, WeightTable(WEIGHTS), "segment", fallback="Unknown",
                        zero_marker="DI", zero_unless=ZERO_UNLESS)
    return out.select(KEY, "segment", "band", *[round6(c).alias(c) for c in FEATS])


# Per-model multipliers on the base weights.
MODEL_MULT = {"gbt": {"totalprice": 1.2, "qty": 0.9}, "rf": {"acctbal": 1.1, "disc": 0.9},
              "lr": {"totalprice": 1.0, "DI_count": 1.2}}


def _model_table():
    """(model, procedure) -> feature weights: base weights x model multiplier;
    the default procedure is AUTOMOBILE (no Unknown column)."""
    rows = []
    for m, mult in MODEL_MULT.items():
        for r in WEIGHTS:
            nr = {"feature": f"{m}|{r['feature']}"}
            for p in ["AUTOMOBILE", "BUILDING", "FURNITURE"]:
                nr[p] = float(r[p]) * float(mult.get(r["feature"], 1.0))
            rows.append(nr)
    return rows


@query("weight_by_model", with_cases("""
SELECT fr.case_id, mm.model, fr.segment, """ + ", ".join(
    r6(f"fr.{f} * CASE WHEN fr.segment IS NULL THEN 1.0 ELSE coalesce(w.{f}, d.{f}) END") + f" AS {f}" for f in FEATS) + """
FROM fr CROSS JOIN (SELECT DISTINCT model FROM mw) mm
LEFT JOIN (SELECT model, procedure, """ + ", ".join(f"max(CASE WHEN feature = '{f}' THEN weight END) AS {f}" for f in FEATS) + """
           FROM mw GROUP BY model, procedure) w ON w.model = mm.model AND w.procedure = fr.segment
JOIN (SELECT model, """ + ", ".join(f"max(CASE WHEN feature = '{f}' THEN weight END) AS {f}" for f in FEATS) + """
      FROM mw WHERE procedure = 'AUTOMOBILE' GROUP BY model) d ON d.model = mm.model""",
    _values_sql(), LONG_SQL, FRAME_SQL,
    "mult(model, feature, m) AS (VALUES " + ", ".join(f"('{m}', '{f}', {v}::DOUBLE)" for m, d in MODEL_MULT.items() for f, v in d.items()) + ")",
    "mw AS (SELECT mo.model, wl.feature, wl.procedure, wl.weight * coalesce(mult.m, 1.0) AS weight "
    "FROM wl CROSS JOIN (VALUES ('gbt'), ('rf'), ('lr')) mo(model) LEFT JOIN mult ON mult.model = mo.model AND mult.feature = wl.feature "
    "WHERE wl.procedure <> 'Unknown')"))
def weight_by_model(spark, sf_dir):
    """W7 in its intended form: per-model multipliers on the base weights,
    row-wise by procedure with AUTOMOBILE as the default (a row without a
    procedure keeps its values); one output row per (case, model)."""
    df = _frame(spark, sf_dir)
    listed = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    rows = []
    for r in WEIGHTS:
        nr = {"feature": r["feature"]}
        for m, mult in MODEL_MULT.items():
            for p in listed:
                nr[f"{m}|{p}"] = float(r[p]) * float(mult.get(r["feature"], 1.0))
        rows.append(nr)
    # one scan: each row is repeated per model (narrow explode of a literal
    # array), then ONE broadcast join on the (model, procedure) key
    wide = (df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODEL_MULT])))
              .withColumn("_mk", F.concat("model", F.lit("|"),
                                          F.when(F.col("segment").isNull() | F.col("segment").isin(*listed), F.col("segment"))
                                           .otherwise(F.lit("AUTOMOBILE")))))
    t = WeightTable(rows)
    out = weight_by_key(wide, t, "_mk", fallback=t.procedures[0], zero_marker=None, leave_null_key=True)
    return out.select(KEY, "model", "segment", *[round6(c).alias(c) for c in FEATS])


# Composite procedures as the mean of two procedure columns.
COMPOSITE = {"AUTO_BUILD": ("AUTOMOBILE", "BUILDING"), "BUILD_FURN": ("BUILDING", "FURNITURE")}


def _composite_key(seg):
    return (F.when(seg.isin("AUTOMOBILE", "BUILDING"), "AUTO_BUILD")
             .when(seg == "FURNITURE", "BUILD_FURN").otherwise("OTHER"))


@query("weights_composite", with_cases(
    "SELECT fr.case_id, fr.segment, " + ", ".join(r6(f"fr.{f} * coalesce(w.{f}, u.{f})") + f" AS {f}" for f in FEATS) + """
FROM (SELECT *, CASE WHEN segment IN ('AUTOMOBILE', 'BUILDING') THEN 'AUTO_BUILD' WHEN segment = 'FURNITURE' THEN 'BUILD_FURN' ELSE 'OTHER' END AS comp FROM fr) fr
LEFT JOIN (SELECT procedure, """ + ", ".join(f"max(CASE WHEN feature = '{f}' THEN weight END) AS {f}" for f in FEATS) + """
           FROM cw WHERE procedure <> 'Unknown' GROUP BY procedure) w ON w.procedure = fr.comp
CROSS JOIN (SELECT """ + ", ".join(f"max(CASE WHEN feature = '{f}' THEN weight END) AS {f}" for f in FEATS) + """
            FROM cw WHERE procedure = 'Unknown') u""",
    _values_sql(), FRAME_SQL,
    "cw AS (SELECT feature, 'AUTO_BUILD' AS procedure, (AUTOMOBILE + BUILDING) / 2 AS weight FROM wt "
    "UNION ALL SELECT feature, 'BUILD_FURN', (BUILDING + FURNITURE) / 2 FROM wt "
    "UNION ALL SELECT feature, 'Unknown', 3.0::DOUBLE FROM wt)"))
def weights_composite(spark, sf_dir):
    """Composite-procedure weights (mean of two columns, Unknown = 3),
    applied row-wise by each row's composite procedure."""
    df = _frame(spark, sf_dir).withColumn("_comp", _composite_key(F.col("segment")))
    t = WeightTable(WEIGHTS).composite(COMPOSITE, unknown=3.0)
    out = weight_by_key(df, t, "_comp", fallback="Unknown", zero_marker=None)
    return out.select(KEY, "segment", *[round6(c).alias(c) for c in FEATS])
