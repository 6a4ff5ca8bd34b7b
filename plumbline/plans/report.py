"""A whole profile of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.profiling.columns import numeric_columns
from plumbline.operators.profiling.quantiles import exact_quantiles
from plumbline.operators.profiling.shapes import histogram, pair_bins, value_ranges
from plumbline.operators.profiling.summary import (
    approx_quantiles,
    boolean_statistics,
    correlations,
    missing_values,
    numeric_statistics,
    temporal_ranges,
    text_statistics,
)
from plumbline.operators.profiling.values import distinct_counts, overview, top_values


def profile(
    df: DataFrame, bins: int = 10, top_k: int = 10, exact: bool = False
) -> dict[str, DataFrame]:
    """Every profile section of `df` as a small frame, keyed by section name.

    The ranges of the numeric columns are found at once, since buckets depend on
    them. Every section is lazy, reads only the columns it needs and returns a
    result whose size does not grow with the rows. Quantiles and distinct counts are
    sketched unless `exact`.
    """
    ranges = value_ranges(df, numeric_columns(df))
    return {
        "overview": overview(df),
        "missing": missing_values(df),
        "numeric": numeric_statistics(df),
        "datetime": temporal_ranges(df),
        "text": text_statistics(df),
        "boolean": boolean_statistics(df),
        "quantiles": exact_quantiles(df) if exact else approx_quantiles(df),
        "distinct": distinct_counts(df, exact=exact),
        "top_values": top_values(df, top_k),
        "histogram": histogram(df, bins, ranges=ranges),
        "correlations": correlations(df),
        "pair_bins": pair_bins(df, bins, ranges=ranges),
    }
