"""A model of the bytes one row occupies, built from the schema.

Fixed-width columns contribute constants, so sizing a table reads only its
variable-width columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import quoted


@dataclass(frozen=True)
class Layout:
    """Per-value constants, in bytes, of one way of holding rows."""

    text: int
    container: int
    date: int
    small_decimal: int
    large_decimal: int


# Fixed values. `wire` is a compact row: an 8-byte slot per variable-width value.
# `pandas` is a 64-bit CPython object column: an 8-byte pointer plus the object's
# header (str 41, ndarray 112, date 32, Decimal 104).
LAYOUTS = {
    "wire": Layout(text=8, container=8, date=4, small_decimal=8, large_decimal=16),
    "pandas": Layout(text=49, container=120, date=40, small_decimal=112, large_decimal=112),
}

# Bytes per value of the fixed-width types.
FIXED_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DayTimeIntervalType: 8,
    T.YearMonthIntervalType: 4,
    T.NullType: 0,
}


class UnsizedType(TypeError):
    """A column whose bytes can't be modelled, so no bound holds for its table."""


def _layout(name: str) -> Layout:
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}, expected one of {sorted(LAYOUTS)}")
    return LAYOUTS[name]


def _length_of(value: Column) -> Column:
    return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)).cast("bigint")


def _width(value: Column, dtype: T.DataType, layout: Layout) -> tuple[int, Column | None]:
    """Split the bytes of `value` into a constant and, if any, a data-dependent part."""
    if isinstance(dtype, T.StructType):
        constant, varying = 0, None
        for field in dtype.fields:
            const, var = _width(value.getField(field.name), field.dataType, layout)
            constant += const
            if var is not None:
                varying = var if varying is None else varying + var
        return constant, varying
    if isinstance(dtype, T.ArrayType):
        const, var = _width(F.lit(None), dtype.elementType, layout)
        if var is None:
            return layout.container, _length_of(value) * const

        def add(total: Column, item: Column) -> Column:
            item_const, item_var = _width(item, dtype.elementType, layout)
            return total + F.lit(item_const) + item_var

        total = F.aggregate(value, F.lit(0).cast("bigint"), add)
        return layout.container, F.coalesce(total, F.lit(0))
    if isinstance(dtype, T.MapType):
        keys = _width(F.map_keys(value), T.ArrayType(dtype.keyType), layout)
        values = _width(F.map_values(value), T.ArrayType(dtype.valueType), layout)
        return keys[0] + values[0], keys[1] + values[1]
    if isinstance(dtype, T.DecimalType):
        return (layout.small_decimal if dtype.precision <= 18 else layout.large_decimal), None
    if isinstance(dtype, T.DateType):
        return layout.date, None
    if type(dtype) in FIXED_WIDTHS:
        return FIXED_WIDTHS[type(dtype)], None
    if isinstance(dtype, (T.StringType, T.BinaryType, T.CharType, T.VarcharType)):
        return layout.text, F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
    if isinstance(dtype, T.VariantType):
        return layout.text, F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)).cast("bigint")
    raise UnsizedType(f"no size is known for {dtype.simpleString()} values; leave the column out")


def row_width(schema: T.StructType, layout: str = "pandas") -> tuple[int, Column | None]:
    """The constant bytes of a row, and an expression for the rest (None if there is none)."""
    chosen = _layout(layout)
    constant, varying = 0, None
    for field in schema.fields:
        const, var = _width(quoted(field.name), field.dataType, chosen)
        constant += const
        if var is not None:
            varying = var if varying is None else varying + var
    return constant, varying


def row_bytes(schema: T.StructType, layout: str = "pandas") -> Column:
    """Bytes of one row as a single expression."""
    constant, varying = row_width(schema, layout)
    total = F.lit(constant).cast("bigint")
    return total if varying is None else total + varying
