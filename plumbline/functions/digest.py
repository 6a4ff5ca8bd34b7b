"""A 16-byte fingerprint of a whole row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import quoted

# Fixed options: keep every digit of nested timestamps and every NULL field.
_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# The two start values.
_SEEDS = (1, 2)


def _settled(value: Column, dtype: T.DataType) -> Column:
    """Equal values written alike: no negative zero, map entries in the order of their keys."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value + F.lit(0.0).cast(dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _settled(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_settled(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType):
        entry = T.StructType().add("key", dtype.keyType).add("value", dtype.valueType)
        entries = F.transform(F.map_entries(value), lambda item: _settled(item, entry))
        order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.array_sort(entries, order)
    return value


def row_digest(schema: T.StructType) -> list[Column]:
    """Two 64-bit hashes `digest_0`, `digest_1` of all values of a row.

    Both together are equal for equal rows and, but for a 128-bit collision,
    only for those. The hash passes over NULL, so each value is followed by
    whether it is NULL; nested values are hashed as text, which keeps their
    boundaries. Grouping on 16 bytes spares the shuffle the width of the row.
    """
    parts = []
    for field in schema.fields:
        value = _settled(quoted(field.name), field.dataType)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            parts.append(F.to_json(F.struct(value.alias("v")), _JSON))
        else:
            parts += [value, value.isNull()]
    return [
        F.xxhash64(F.lit(seed), *parts).alias(f"digest_{i}") for i, seed in enumerate(_SEEDS)
    ]
