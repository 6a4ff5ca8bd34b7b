"""Profile sections made of plain aggregates: no data shuffle, only the columns needed."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import quoted
from plumbline.operators.profiling.columns import (
    FLOATING,
    boolean_columns,
    facts_frame,
    finite_number,
    numeric_columns,
    present,
    present_number,
    temporal_columns,
    text_columns,
)
from plumbline.operators.profiling.wide import matrix_correlations
from plumbline.operators.sketches import quantile_of, quantile_sketches

# The points of a default quantile summary.
QUANTILE_POINTS = (0.05, 0.25, 0.5, 0.75, 0.95)
# Columns or pairs computed by one aggregation; wider tables take several.
COLUMNS_PER_PASS = 30
STATISTICS_PER_PASS = 2
PAIRS_PER_PASS = 5

MISSING_SCHEMA = "column string, n_missing bigint, share_missing double"
NUMERIC_SCHEMA = (
    "column string, n bigint, mean double, stddev double, min double, max double, "
    "sum double, n_zeros bigint, skewness double, kurtosis double, "
    "min_exact string, max_exact string, sum_exact string"
)
QUANTILE_SCHEMA = "column string, quantile double, value double"
DISTINCT_SCHEMA = "column string, n_distinct bigint"
CORRELATION_SCHEMA = "column_a string, column_b string, correlation double"
TEXT_SCHEMA = (
    "column string, n bigint, n_empty bigint, min_length bigint, mean_length double, "
    "max_length bigint"
)
BOOLEAN_SCHEMA = "column string, n_true bigint, n_false bigint, n_missing bigint"
TEMPORAL_SCHEMA = (
    "column string, n bigint, min_ts timestamp_ntz, max_ts timestamp_ntz, span_seconds bigint"
)


def missing_facts(df: DataFrame, columns: list[str]) -> list[Column]:
    rows = F.count(F.lit(1))
    facts = []
    for name in columns:
        missing = rows - F.count(present(df, name))
        share = F.try_divide(missing, rows)
        facts.append(
            F.struct(
                F.lit(name).alias("column"), missing.alias("n_missing"), share.alias("share_missing")
            )
        )
    return facts


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and share per column."""
    facts = missing_facts(df, columns or df.columns)
    return facts_frame(df, facts, MISSING_SCHEMA, COLUMNS_PER_PASS)


def numeric_facts(df: DataFrame, columns: list[str]) -> list[Column]:
    facts = []
    for name in columns:
        value = present_number(df, name)
        # Merged moments of a constant can miss zero by a rounding error.
        varied = F.min(value) < F.max(value)
        stddev = F.stddev_samp(value)
        facts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.when(varied, stddev).otherwise(stddev * 0).alias("stddev"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                F.sum(value).alias("sum"),
                F.count_if(value == 0).alias("n_zeros"),
                F.when(varied, F.skewness(value)).alias("skewness"),
                F.when(varied, F.kurtosis(value)).alias("kurtosis"),
                *_exact(df, name),
            )
        )
    return facts


def _exact(df: DataFrame, name: str) -> list[Column]:
    """Range and sum of whole numbers and decimals with all their digits; NULL for floats."""
    dtype, value = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, FLOATING):
        found = [F.lit(None)] * 3
    else:
        found = [F.min(value), F.max(value), _exact_sum(value, dtype)]
    names = ("min_exact", "max_exact", "sum_exact")
    return [v.cast("string").alias(n) for v, n in zip(found, names, strict=True)]


def _exact_sum(value: Column, dtype: T.DataType) -> Column:
    """Whole numbers are summed as longs, 22 bits of them at a time: no sum overflows before 2^41 rows."""
    if isinstance(dtype, T.DecimalType):
        return F.sum(value.cast(T.DecimalType(28 + dtype.scale if dtype.scale <= 10 else 38, dtype.scale)))
    whole, low = value.cast("bigint"), F.lit((1 << 22) - 1)
    parts = [F.shiftright(whole, 44), F.shiftright(whole, 22).bitwiseAND(low), whole.bitwiseAND(low)]
    wide = [F.sum(part).cast("decimal(20,0)") for part in parts]
    return (wide[0] * F.lit(1 << 22).cast("decimal(8,0)") + wide[1]).cast("decimal(30,0)") * F.lit(1 << 22).cast("decimal(8,0)") + wide[2]


def numeric_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, spread, range, sum, zeros and shape of numeric columns.

    Skewness and excess kurtosis are the population forms. The figures are doubles;
    `min_exact`, `max_exact` and `sum_exact` hold all digits of whole numbers and
    decimals as text.
    """
    facts = numeric_facts(df, columns or numeric_columns(df))
    return facts_frame(df, facts, NUMERIC_SCHEMA, STATISTICS_PER_PASS)


def text_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values, empty ones and lengths in characters of text columns."""
    facts = []
    for name in columns or text_columns(df):
        value, length = quoted(name), F.length(quoted(name))
        facts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(value).alias("n"),
                F.count_if(length == 0).alias("n_empty"),
                F.min(length).cast("bigint").alias("min_length"),
                F.avg(length).alias("mean_length"),
                F.max(length).cast("bigint").alias("max_length"),
            )
        )
    return facts_frame(df, facts, TEXT_SCHEMA, COLUMNS_PER_PASS)


def boolean_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How often boolean columns are true, false and missing."""
    facts = []
    for name in columns or boolean_columns(df):
        value = quoted(name)
        facts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count_if(value).alias("n_true"),
                F.count_if(~value).alias("n_false"),
                F.count_if(value.isNull()).alias("n_missing"),
            )
        )
    return facts_frame(df, facts, BOOLEAN_SCHEMA, COLUMNS_PER_PASS)


def temporal_facts(df: DataFrame, columns: list[str]) -> list[Column]:
    facts = []
    for name in columns:
        low, high = F.min(quoted(name)), F.max(quoted(name))
        if isinstance(df.schema[name].dataType, T.TimestampType):
            # Instants: a change of the clocks between them is no part of the span.
            span = F.floor((F.unix_micros(high) - F.unix_micros(low)) / F.lit(1_000_000))
        else:
            span = F.timestamp_diff("SECOND", low.cast("timestamp_ntz"), high.cast("timestamp_ntz"))
        low, high = low.cast("timestamp_ntz"), high.cast("timestamp_ntz")
        facts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(quoted(name)).alias("n"),
                low.alias("min_ts"),
                high.alias("max_ts"),
                span.cast("bigint").alias("span_seconds"),
            )
        )
    return facts


def temporal_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """First and last instant and whole seconds between them, per date or timestamp column."""
    facts = temporal_facts(df, columns or temporal_columns(df))
    return facts_frame(df, facts, TEMPORAL_SCHEMA, COLUMNS_PER_PASS)


def approx_quantiles(
    df: DataFrame,
    columns: list[str] | None = None,
    points: tuple[float, ...] = QUANTILE_POINTS,
) -> DataFrame:
    """Quantiles off by about 0.1% of the rows in rank, from mergeable sketches."""
    names = columns or numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], QUANTILE_SCHEMA)
    sketches = quantile_sketches(df, [present_number(df, name) for name in names])
    per_column = [
        F.struct(F.lit(name).alias("column"), quantile_of(f"s{i}", points).alias("found"))
        for i, name in enumerate(names)
    ]
    found = sketches.select(F.inline(F.array(*per_column)))
    pairs = [
        F.struct(F.lit(float(p)).alias("quantile"), F.element_at("found", i).alias("value"))
        for i, p in enumerate(points, start=1)
    ]
    return found.where(F.col("found").isNotNull()).select("column", F.inline(F.array(*pairs)))


def distinct_facts(df: DataFrame, columns: list[str]) -> list[Column]:
    return [
        F.struct(
            F.lit(name).alias("column"),
            F.approx_count_distinct(present(df, name)).alias("n_distinct"),
        )
        for name in columns
    ]


def column_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """Every unordered pair of different columns, names in alphabetical order."""
    return list(combinations(sorted(columns), 2))


def correlation_facts(df: DataFrame, pairs: list[tuple[str, str]]) -> list[Column]:
    """Pearson correlation per pair over the rows where both values are finite.

    Written as covariance over the two deviations because `corr` divides by zero
    on a constant column in ANSI mode; here that gives NULL. Merged deviations of a
    constant can miss zero by a rounding error, hence the look at its range.
    """
    facts = []
    for a, b in pairs:
        x, y = finite_number(df, a), finite_number(df, b)
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        facts.append(
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                F.when(varied, F.try_divide(F.covar_pop(x, y), spread)).alias("correlation"),
            )
        )
    return facts


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, in long form.

    One scan forms the sums of all pairs as matrix products. Pairs whose spread is
    small beside their values, where such sums lose digits, are computed again by the
    built-in aggregates, so that the answer doesn't depend on the other columns.
    """
    names = sorted(columns or numeric_columns(df))
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], CORRELATION_SCHEMA)
    sound, again = matrix_correlations(df, names)
    facts = correlation_facts(df, again)
    if not facts:
        return sound
    return sound.unionByName(facts_frame(df, facts, CORRELATION_SCHEMA, PAIRS_PER_PASS))
