"""Parsing, casting, lookups and missing-value expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none needs a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "round6", "round2", "to_str", "parse_count", "band_ordinal", "map_lookup",
    "missing_indicator", "fill_int", "binarize", "coerce_numeric", "fill_label",
    "literal_map",
]

# The marker of the open-ended top count ("6 times or more")
# and the value it stands for.
COUNT_OPEN_MARKER = "회 이상"
COUNT_OPEN_VALUE = 6
COUNT_PATTERN = r"(\d+)회?"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c: str | Column) -> Column:
    """Half-up rounding to 6 decimals written as plain IEEE arithmetic
    (floor(x * 1e6 + 0.5) / 1e6) so any SQL engine reproduces it bit for bit."""
    return F.floor(col_of(c) * 1e6 + 0.5) / 1e6


def round2(c: str | Column) -> Column:
    return F.floor(col_of(c) * 100.0 + 0.5) / 100.0


def to_str(c: str | Column, missing: str = "nan") -> Column:
    """Cast to string; a missing value becomes the text ``missing``."""
    return F.coalesce(col_of(c).cast("string"), F.lit(missing))


def parse_count(c: str | Column, as_float: bool = False, pattern: str = COUNT_PATTERN,
                open_marker: str = COUNT_OPEN_MARKER, open_value: int = COUNT_OPEN_VALUE) -> Column:
    """Count strings such as ``'3회'`` / ``'6회 이상'`` -> number.

    missing -> 0; contains the open-ended marker -> ``open_value``; first
    match of ``pattern`` -> its digits; anything else -> 0.
    """
    x = col_of(c)
    digits = F.nullif(F.regexp_extract(F.trim(x), pattern, 1), F.lit(""))
    out = (F.when(x.isNull(), F.lit(0))
            .when(x.contains(open_marker), F.lit(open_value))
            .otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(0))))
    return out.cast("double" if as_float else "bigint")


def literal_map(mapping: Mapping[str, object]) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def band_ordinal(c: str | Column, mapping: Mapping[str, float | None], default: float = 0.0) -> Column:
    """Ordered band -> number on the trimmed text.

    Listed levels map to their value (a level mapped to ``None`` gives NULL),
    unlisted levels and missing input give ``default``.
    """
    t = F.trim(col_of(c))
    null_levels = [k for k, v in mapping.items() if v is None]
    valued = {k: float(v) for k, v in mapping.items() if v is not None}
    looked = F.coalesce(F.try_element_at(literal_map(valued), t), F.lit(float(default))) if valued \
        else F.lit(float(default))
    if null_levels:
        return F.when(t.isin(*null_levels), F.lit(None).cast("double")).otherwise(looked)
    return looked


def map_lookup(c: str | Column, mapping: Mapping[str, float], default: float | None = None,
               trim: bool = False) -> Column:
    """Dictionary lookup; unlisted or missing -> ``default`` (NULL if None)."""
    x = col_of(c)
    if trim:
        x = F.trim(x)
    v = F.try_element_at(literal_map({k: float(v) for k, v in mapping.items()}), x)
    return F.coalesce(v, F.lit(float(default))) if default is not None else v


def missing_indicator(c: str | Column, level: str, trim: bool = True) -> Column:
    """1.0 where the value equals the text level meaning "unknown", else 0.0."""
    x = col_of(c)
    if trim:
        x = F.trim(x)
    return F.coalesce((x == F.lit(level)).cast("double"), F.lit(0.0))


def fill_int(c: str | Column, value: int = 0) -> Column:
    return F.coalesce(col_of(c), F.lit(value)).cast("int")


def binarize(c: str | Column, threshold: float = 1) -> Column:
    return (col_of(c) >= F.lit(threshold)).cast("int")


def coerce_numeric(c: str | Column, default: float = 0.0) -> Column:
    """Text -> double; unparsable, NaN or missing -> ``default``."""
    d = col_of(c).cast("string").try_cast("double")
    return F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(float(default)))


def fill_label(c: str | Column, label: str = "Unknown") -> Column:
    return F.coalesce(col_of(c), F.lit(label))
