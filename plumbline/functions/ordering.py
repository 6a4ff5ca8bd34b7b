"""Numbers that sort like the values they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def sort_number(value: Column, dtype: T.DataType) -> Column | None:
    """A number in the order of `value`, None for types without one."""
    if isinstance(dtype, WHOLE):
        return value.cast("bigint")
    if isinstance(dtype, (*FLOATING, T.DecimalType)):
        return value.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", _ntz_epoch(), value)
    return None


def from_sort_number(number: float, dtype: T.DataType) -> Column:
    """A constant of type `dtype` near `number`; filters on it push down."""
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.lit(int(number)).cast("int"))
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(int(number)))
    if isinstance(dtype, T.TimestampNTZType):
        return _ntz_epoch() + F.expr("INTERVAL '0.000001' SECOND") * F.lit(int(number))
    return F.lit(number).try_cast(dtype)


def _ntz_epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
