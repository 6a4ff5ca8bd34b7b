"""Exact quantiles without gathering a column in one task."""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame

from plumbline.operators.profiling.columns import numeric_columns
from plumbline.operators.profiling.radix import LISTED_VALUES, column_ranges, order_statistics
from plumbline.operators.profiling.summary import QUANTILE_POINTS, QUANTILE_SCHEMA

TYPED_SCHEMA = "column string, quantile double, lower string, upper string, share_upper double, value double"


def _neighbours(point: float, n: int) -> tuple[int, int, float]:
    """The two places around a quantile of `n` values, and the share of the upper one."""
    rank = point * (n - 1)
    below = math.floor(rank)
    return below, math.ceil(rank), rank - below


def _between(lower: object, upper: object, share: float) -> float:
    """The interpolated value as a double, rounded once where the values aren't floats."""
    if not share or lower == upper:
        return float(lower)
    if isinstance(lower, float):
        return lower * (1.0 - share) + upper * share
    return float(Fraction(lower) + (Fraction(upper) - Fraction(lower)) * Fraction(share))


def _digits(value: object) -> str | None:
    """All digits of a whole number or a decimal."""
    if isinstance(value, float):
        return None
    return f"{value:f}" if isinstance(value, Decimal) else str(value)


def typed_quantiles(
    df: DataFrame,
    columns: list[str] | None = None,
    points: tuple[float, ...] = QUANTILE_POINTS,
    listed_values: int = LISTED_VALUES,
) -> DataFrame:
    """Quantiles and the two values that each lies between, in the column's own type.

    `lower` and `upper` hold all digits of whole numbers and decimals as text (NULL for
    floats, which `value` holds), `share_upper` the weight of the upper one; `value` is the
    linear interpolation, computed exactly and rounded to a double once. The values come
    from radix selection, so neither digits nor rows are approximated at any size.
    Columns without a value have no rows; NULL and NaN are left out.
    """
    names = columns or numeric_columns(df)
    ranges = column_ranges(df, names)
    wanted = {name: [place for p in points for place in _neighbours(p, ranges[name][0])[:2]] for name in names if ranges[name][0]}
    found = order_statistics(df, wanted, ranges, listed_values)
    rows = []
    for name in wanted:
        for point in points:
            below, above, share = _neighbours(point, ranges[name][0])
            lower, upper = found[name, below], found[name, above]
            rows.append((name, float(point), _digits(lower), _digits(upper), share, _between(lower, upper, share)))
    return df.sparkSession.createDataFrame(rows, TYPED_SCHEMA)


def exact_quantiles(
    df: DataFrame,
    columns: list[str] | None = None,
    points: tuple[float, ...] = QUANTILE_POINTS,
    listed_values: int = LISTED_VALUES,
) -> DataFrame:
    """Quantiles with linear interpolation between neighbouring values, exact at any size."""
    found = typed_quantiles(df, columns, points, listed_values)
    return found.select(*[part.split()[0] for part in QUANTILE_SCHEMA.split(", ")])
