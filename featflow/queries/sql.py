"""SQL text of the fixtures for the DuckDB oracle (same definitions as
featflow.plans.fixtures, written independently in SQL)."""

CASES_CTES = """
li AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, floor(avg(l_discount) * 1e6 + 0.5) / 1e6 AS disc
  FROM lineitem GROUP BY l_orderkey
),
cases AS (
  SELECT o.o_orderkey AS case_id,
    CASE WHEN o.o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o.o_orderpriority END AS priority,
    o.o_orderstatus AS status, c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS region,
    CASE WHEN o.o_orderkey % 17 = 0 THEN 'unknown'
         ELSE 'b' || CAST(least(CAST(floor(o.o_totalprice / 100000) AS BIGINT), 4) + 1 AS VARCHAR) END AS band,
    CASE WHEN o.o_orderkey % 23 = 0 THEN NULL
         WHEN coalesce(li.n_lines, 0) >= 6 THEN '6회 이상'
         ELSE CAST(coalesce(li.n_lines, 0) AS VARCHAR) || '회' END AS count_str,
    o.o_totalprice AS totalprice,
    CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal END AS acctbal,
    li.qty AS qty, li.disc AS disc,
    CAST(CASE WHEN 0.5 * o.o_totalprice / 500000 + 0.5 * ((o.o_orderkey * 7919 + 104729) % 1009) / 1009 > 0.64
         THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
)"""

SCORES_CTES = """
score_wide AS (
  SELECT case_id, label,
    CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', case_id)), case_id) - 1) % 5 AS INTEGER) AS fold,
    floor(totalprice / 500000 * 100 + 0.5) / 100 AS a,
    floor(((case_id * 31 + 7) % 997) / 997 * 100 + 0.5) / 100 AS b,
    floor((totalprice * 6 / 5000000 + ((case_id * 7919 + 104729) % 1009) * 4 / 10090) * 100 + 0.5) / 100 AS c
  FROM cases
),
scores AS (
  SELECT case_id, fold, 'a' AS model, a AS score, label FROM score_wide
  UNION ALL SELECT case_id, fold, 'b', b, label FROM score_wide
  UNION ALL SELECT case_id, fold, 'c', c, label FROM score_wide
)"""


def r6(expr: str) -> str:
    """Same rounding as featflow.functions.round6."""
    return f"(floor(({expr}) * 1e6 + 0.5) / 1e6)"


def with_cases(body: str, *extra: str, scores: bool = False) -> str:
    ctes = [CASES_CTES.strip()]
    if scores:
        ctes.append(SCORES_CTES.strip())
    ctes += [e.strip() for e in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def auc_sql(src: str, by: list[str], score: str = "score", label: str = "label") -> str:
    """AUC per group with ties counted half, from distinct-score counts."""
    b = ", ".join(by)
    bc = (b + ", ") if by else ""
    part = f"PARTITION BY {b} " if by else ""
    return f"""(SELECT {bc}sum(n_pos * (2 * neg_below + n_neg)) / (2.0 * sum(n_pos) * sum(n_neg)) AS auc,
   CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(n_neg) AS BIGINT) AS n_neg FROM (
  SELECT *, coalesce(sum(n_neg) OVER ({part}ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM (SELECT {bc}{score}, sum({label}) AS n_pos, sum(1 - {label}) AS n_neg FROM {src} GROUP BY {bc}{score})
) {"GROUP BY " + b if by else ""})"""
