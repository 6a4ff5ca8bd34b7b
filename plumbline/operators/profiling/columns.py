"""Which columns a profile looks at, and how a missing value is told apart."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import quoted

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)
FLOATING = (T.FloatType, T.DoubleType)

AGGREGATES_PER_PASS = 50
STRUCTS_PER_SCAN = 30


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]


def flat_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared and shown as text."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN counted as missing like NULL."""
    value = quoted(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(value), value)
    return value


def present_number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def finite_number(df: DataFrame, name: str) -> Column:
    """The value as a double, with NaN and the infinities dropped."""
    value = quoted(name).cast("double")
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return value


def chunked(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def facts_frame(df: DataFrame, facts: list[Column], schema: str, per_pass: int) -> DataFrame:
    """Aggregate `df` to one struct per fact and spread the structs over rows.

    Facts are computed `per_pass` at a time: the code generated for a wide
    aggregation outgrows the JIT compiler and each further fact then costs far
    more than a pass of its own, which reads only its own columns.
    """
    if not facts:
        return df.sparkSession.createDataFrame([], schema)
    return union_all(
        df.agg(F.array(*chunk).alias("facts")).select(F.inline("facts"))
        for chunk in chunked(facts, per_pass)
    )


def aggregate_values(df: DataFrame, aggregates: list[Column]) -> list:
    """The values of single-valued aggregates, AGGREGATES_PER_PASS of them per job."""
    values = []
    for chunk in chunked(aggregates, AGGREGATES_PER_PASS):
        values += df.agg(*[agg.alias(f"v{i}") for i, agg in enumerate(chunk)]).first()
    return values


def spread(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One row per input row and struct, STRUCTS_PER_SCAN structs per scan."""
    return union_all(
        df.select(F.inline(F.array(*chunk))) for chunk in chunked(structs, STRUCTS_PER_SCAN)
    )


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
