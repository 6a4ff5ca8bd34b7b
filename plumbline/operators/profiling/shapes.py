"""Profile sections on equal-width buckets: histograms and pairwise densities."""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.binning import equal_width_bucket
from plumbline.functions.names import quoted
from plumbline.operators.profiling.columns import (
    aggregate_values,
    finite_number,
    numeric_columns,
    spread,
)
from plumbline.operators.profiling.dense import cell_counts


class Range(NamedTuple):
    low: float | None
    high: float | None


HISTOGRAM_SCHEMA = "column string, bucket bigint, lower double, upper double, n bigint"
VALUE_PAIR_SCHEMA = "column_a string, column_b string, value_a string, value_b string, n bigint"
PAIR_SCHEMA = "column_a string, column_b string, bucket_a bigint, bucket_b bigint, n bigint"


def value_ranges(df: DataFrame, columns: list[str]) -> dict[str, Range]:
    """Smallest and largest finite value per column, two numbers each on the driver."""
    if not columns:
        return {}
    ends = []
    for name in columns:
        ends += [F.min(finite_number(df, name)), F.max(finite_number(df, name))]
    row = aggregate_values(df, ends)
    return {name: Range(row[2 * i], row[2 * i + 1]) for i, name in enumerate(columns)}


def histogram(
    df: DataFrame,
    bins: int = 10,
    columns: list[str] | None = None,
    ranges: dict[str, Range] | None = None,
) -> DataFrame:
    """Rows per equal-width bucket of each numeric column, empty buckets left out.

    One scan for the ranges, unless given, and one for the counts. Each task counts into
    arrays, so the shuffle carries at most bins rows per column and task.
    """
    names = columns or numeric_columns(df)
    ranges = value_ranges(df, names) if ranges is None else ranges
    names = [name for name in names if ranges[name].low is not None]
    if not names:
        return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
    buckets = [equal_width_bucket(finite_number(df, name), *ranges[name], bins) for name in names]
    counts = cell_counts(df, buckets, [(i,) for i in range(len(names))], bins)
    counts = counts.withColumn("bucket", F.col("cell") + 1)
    index = F.col("id") + 1
    low = F.element_at(F.array(*[F.lit(float(ranges[name].low)) for name in names]), index)
    high = F.element_at(F.array(*[F.lit(float(ranges[name].high)) for name in names]), index)
    width = (high - low) / F.lit(float(bins))
    return counts.select(
        F.element_at(F.array(*[F.lit(name) for name in names]), index).alias("column"),
        "bucket",
        (low + width * (F.col("bucket") - 1)).alias("lower"),
        (low + width * F.col("bucket")).alias("upper"),
        "n",
    )


def pair_bins(
    df: DataFrame,
    bins: int = 10,
    columns: list[str] | None = None,
    ranges: dict[str, Range] | None = None,
) -> DataFrame:
    """Two-dimensional bucket counts for every pair of different numeric columns.

    The data behind a scatter matrix at a size that does not grow with the rows:
    at most bins * bins cells per pair. A row counts for a pair when both values
    are present. Each column is bucketed once per row, and each task counts the bucket
    numbers of all pairs into dense arrays.
    """
    names = sorted(columns or numeric_columns(df))
    ranges = value_ranges(df, names) if ranges is None else ranges
    names = [name for name in names if ranges[name].low is not None]
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    buckets = [equal_width_bucket(finite_number(df, name), *ranges[name], bins) for name in names]
    index, cell = F.col("id") + 1, F.col("cell")
    return cell_counts(df, buckets, pairs, bins).select(
        F.element_at(F.array(*[F.lit(names[a]) for a, _ in pairs]), index).alias("column_a"),
        F.element_at(F.array(*[F.lit(names[b]) for _, b in pairs]), index).alias("column_b"),
        (F.floor(cell / bins) + 1).cast("bigint").alias("bucket_a"),
        (cell % bins + 1).alias("bucket_b"),
        "n",
    )


def value_pairs(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Rows per pair of values for every pair of the given columns, of any flat type.

    The values of a text or boolean column are its buckets, as they are; numbers fall
    into equal-width buckets, named by their number. Nothing is left out, so give columns
    of few values: the result has as many rows as pairs of values occur. A row counts for
    a pair when both values are present.
    """
    names = sorted(columns)
    numeric = [name for name in names if name in numeric_columns(df)]
    ranges = value_ranges(df, numeric)
    shown = []
    for i, name in enumerate(names):
        if name not in ranges:
            value = quoted(name)
        elif ranges[name].low is None:
            value = F.lit(None)
        else:
            value = equal_width_bucket(finite_number(df, name), *ranges[name], bins)
        shown.append(value.cast("string").alias(f"v{i}"))
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], VALUE_PAIR_SCHEMA)
    cells = [
        F.struct(
            F.lit(names[a]).alias("column_a"),
            F.lit(names[b]).alias("column_b"),
            F.col(f"v{a}").alias("value_a"),
            F.col(f"v{b}").alias("value_b"),
        )
        for a, b in pairs
    ]
    keys = ["column_a", "column_b", "value_a", "value_b"]
    return (
        spread(df.select(*shown), cells)
        .where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
