"""Derived-feature expressions: ratios, decays, flags, cuts, products, clips.

Each helper returns Columns (or (name, Column) pairs) so a caller adds any
number of features in ONE ``select`` instead of a ``withColumn`` loop.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featflow.functions.parse import col_of

__all__ = [
    "ratio", "decay", "flag", "absdiff", "cut", "square", "product", "weighted_sum",
    "named_pairs", "positional_pairs", "risk_index", "clip", "with_columns",
    "leaky_columns", "LEAKY_KEYWORDS",
]


def ratio(a, b, offset: float = 1.0) -> Column:
    """a / (b + offset); NULL where the denominator is zero."""
    return F.try_divide(col_of(a).cast("double"), col_of(b) + F.lit(offset))


def decay(c) -> Column:
    return F.exp(-col_of(c))


def flag(c, threshold: float = 0.0) -> Column:
    return col_of(c) > F.lit(threshold)


def absdiff(a, b) -> Column:
    return F.abs(col_of(a) - col_of(b))


def cut(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed interval binning with open ends:
    (-inf, e0] -> labels[0], (e0, e1] -> labels[1], ..., (e_last, inf) -> labels[-1].
    (``Bucketizer`` is left-closed, so it is not used.)"""
    if len(labels) != len(edges) + 1:
        raise ValueError("need len(edges) + 1 labels")
    x = col_of(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, lab in zip(edges, labels):
        out = out.when(x <= F.lit(float(e)), F.lit(lab))
    return out.otherwise(F.lit(labels[-1]))


def square(c) -> Column:
    x = col_of(c)
    return x * x


def product(a, b) -> Column:
    return col_of(a) * col_of(b)


def weighted_sum(cols_weights: Sequence[tuple[object, float]]) -> Column:
    out = None
    for c, w in cols_weights:
        term = col_of(c) * F.lit(float(w))
        out = term if out is None else out + term
    return out


def cross_products(columns: Sequence[str], suffix: str,
                   last: tuple[int, int] | None = None) -> list[tuple[str, Column]]:
    """Named products of unordered column pairs, in column order. ``last``
    bounds the positions of the first and the second member of a pair."""
    limit = last or (len(columns), len(columns))
    chosen = (pair for pair in combinations(enumerate(columns), 2)
              if all(position < bound for (position, _), bound in zip(pair, limit)))
    return [(f"{a}_{b}_{suffix}", F.col(a) * F.col(b)) for (_, a), (_, b) in chosen]


def named_pairs(columns: Sequence[str], wanted: Sequence[str], suffix: str = "interaction") -> list[tuple[str, Column]]:
    """Products of all pairs of the ``wanted`` features that exist, in ``wanted`` order."""
    return cross_products(sorted(set(wanted) & set(columns), key=list(wanted).index), suffix)


def positional_pairs(columns: Sequence[str], first: int = 10, second: int = 11,
                     suffix: str = "interact") -> list[tuple[str, Column]]:
    """Products by position: the first member among the first ``first``
    columns, the second among the first ``second``."""
    return cross_products(columns, suffix, last=(first, second))


def risk_index(c, knee1: float = 35.0, slope1: float = 1.5, knee2: float = 40.0,
               slope2: float = 2.0, scale: float = 30.0) -> Column:
    """Piecewise stretch applied in two steps: above ``knee1`` the excess is
    multiplied by ``slope1``; the *stretched* value above ``knee2`` is then
    stretched by ``slope2``; the result is divided by ``scale``."""
    x = col_of(c)
    s1 = F.when(x > knee1, F.lit(knee1) + (x - F.lit(knee1)) * F.lit(slope1)).otherwise(x)
    s2 = F.when(s1 > knee2, F.lit(knee2) + (s1 - F.lit(knee2)) * F.lit(slope2)).otherwise(s1)
    return s2 / F.lit(scale)


def clip(c, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``greatest`` alone would skip it)."""
    x = col_of(c)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, lo_c), hi_c))


def with_columns(df: DataFrame, pairs: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add or replace many columns in one projection."""
    return df.withColumns(dict(pairs))


# Name keywords that mark a column as a likely target leak
# (matched on the lower-cased column name), and the explicit extra rule
# (exact name, or a name holding both fragments).
LEAKY_KEYWORDS = ["성공", "임신", "target", "score", "outcome", "result", "예측", "prediction"]
LEAKY_EXACT = "난자 해동 경과일"
LEAKY_BOTH = ("해동", "경과")


class NameRule(NamedTuple):
    """A rule on column names: a regular expression and its flags."""
    pattern: str
    flags: int = 0

    def matches(self, name: str) -> bool:
        return re.search(self.pattern, name, self.flags) is not None


def any_of(words: Sequence[str]) -> str:
    return "|".join(map(re.escape, words))


LEAKY_RULES = (NameRule(any_of(LEAKY_KEYWORDS), re.IGNORECASE), NameRule(rf"\A{re.escape(LEAKY_EXACT)}\Z"),
               NameRule("".join(f"(?=.*{re.escape(part)})" for part in LEAKY_BOTH)))


def leaky_columns(columns: Sequence[str], rules: Sequence[NameRule] = LEAKY_RULES) -> list[str]:
    """Columns whose name meets any of the rules."""
    return [name for name in columns if any(map(lambda rule: rule.matches(name), rules))]
