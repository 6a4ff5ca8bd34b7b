"""Order statistics by radix selection, in the columns' own types.

Every number has a key, an unsigned whole number in the order of the values: 64 bits of
whole numbers and floats, 128 bits of decimals. A pass counts, in every task, the values
under the wanted prefixes by their next 16 bits, as dense arrays; the merged counts say
which prefix, 16 bits longer, holds each wanted position. Digits that the smallest and the
largest value share are skipped, and once few values are left under the prefixes of a
column, one pass lists all their remaining bits. A pass moves counts, never rows, and no
task gets more than a prefix's counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.profiling.columns import FLOATING, aggregate_values, chunked, present

DIGIT_BITS = 16
DIGITS = 1 << DIGIT_BITS
# Prefixes counted in one pass: half a megabyte each in a task.
PREFIXES_PER_PASS = 64
# Values under the prefixes of a column whose remaining bits, at most so many, are listed at once.
LISTED_VALUES = 1_000_000
LISTED_BITS = 48

_SIGN = np.uint64(1 << 63)
_WORD = (1 << 64) - 1
_EXACT = Context(prec=60)


@dataclass(frozen=True)
class Position:
    """A wanted place in a column's order, from 0, and the key's first bits as far as they are known."""

    column: str
    at: int
    prefix: int
    known_bits: int
    below: int
    inside: int


def key_bits(dtype: T.DataType) -> int:
    return 128 if isinstance(dtype, T.DecimalType) else 64


def key_words(column: pa.Array) -> list[np.ndarray]:
    """Keys of all values but NULL as unsigned words, the first one most significant."""
    column = column.drop_null()
    if pa.types.is_decimal(column.type):
        raw = np.frombuffer(column.buffers()[1], dtype="<u8")[2 * column.offset : 2 * (column.offset + len(column))]
        return [raw[1::2] ^ _SIGN, raw[0::2]]
    if pa.types.is_floating(column.type):
        # Adding zero turns its negative into it.
        bits = (column.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).view(np.uint64)
        return [np.where(bits >= _SIGN, ~bits, bits | _SIGN)]
    return [column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN]


def key_of(value: object, dtype: T.DataType) -> int:
    """The key of one value."""
    if isinstance(dtype, T.DecimalType):
        return int(value.scaleb(dtype.scale, _EXACT)) + (1 << 127)
    array = pa.array([float(value)], pa.float64()) if isinstance(dtype, FLOATING) else pa.array([int(value)], pa.int64())
    return int(key_words(array)[0][0])


def value_of(key: int, dtype: T.DataType) -> object:
    """The value with a key."""
    if isinstance(dtype, T.DecimalType):
        return Decimal(key - (1 << 127)).scaleb(-dtype.scale, _EXACT)
    if isinstance(dtype, FLOATING):
        bits = key ^ (1 << 63) if key >> 63 else ~key & _WORD
        return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])
    return key - (1 << 63)


def _under(words: list[np.ndarray], prefix: int, known: int) -> np.ndarray:
    """Which keys begin with a prefix."""
    fits = np.ones(len(words[0]), dtype=bool)
    for k, word in enumerate(words):
        bits = min(max(known - 64 * k, 0), 64)
        if bits:
            rest = max(known - 64 * (k + 1), 0)
            fits &= (word >> np.uint64(64 - bits)) == np.uint64((prefix >> rest) & ((1 << bits) - 1))
    return fits


def _next_bits(words: list[np.ndarray], known: int, bits: int) -> np.ndarray:
    """The bits of each key that follow the first `known` ones."""
    out = np.zeros(len(words[0]), dtype=np.int64)
    for k, word in enumerate(words):
        first, last = max(known, 64 * k), min(known + bits, 64 * (k + 1))
        if first < last:
            part = (word >> np.uint64(64 * (k + 1) - last)) & np.uint64((1 << (last - first)) - 1)
            out = (out << (last - first)) | part.astype(np.int64)
    return out


@dataclass(frozen=True)
class Count:
    """What a pass counts: the keys of column number `column` under a prefix by their next bits."""

    column: int
    prefix: int
    known_bits: int
    bits: int


_SCHEMA = "count int, digit bigint, n bigint"


def _counted(df: DataFrame, names: list[str], counts: list[Count]) -> DataFrame:
    """Keys per (`count`, `digit`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {i: np.zeros(DIGITS, dtype=np.int64) for i, c in enumerate(counts) if c.bits <= DIGIT_BITS}
        listed = {i: [(np.empty(0, np.int64), np.empty(0, np.int64))] for i in range(len(counts)) if i not in dense}
        for batch in batches:
            words = [key_words(column) for column in batch.columns]
            for i, c in enumerate(counts):
                fits = [w[_under(words[c.column], c.prefix, c.known_bits)] for w in words[c.column]]
                digits = _next_bits(fits, c.known_bits, c.bits)
                if i in dense:
                    dense[i] += np.bincount(digits, minlength=DIGITS)
                elif len(digits):
                    listed[i].append(np.unique(digits, return_counts=True))
        for i in range(len(counts)):
            if i in dense:
                digits = np.flatnonzero(dense[i])
                n = dense[i][digits]
            else:
                digits, n = (np.concatenate(x) for x in zip(*listed[i], strict=True))
            yield pa.RecordBatch.from_pydict(
                {"count": pa.array(np.full(len(digits), i, np.int32)), "digit": pa.array(digits), "n": pa.array(n)}
            )

    values = df.select(*[present(df, name).alias(f"c{k}") for k, name in enumerate(names)])
    return values.mapInArrow(count, _SCHEMA).groupBy("count", "digit").agg(F.sum("n").alias("n"))


def _longer(df: DataFrame, positions: list[Position], listed_values: int) -> list[Position]:
    """One pass: the positions with more of their keys known."""
    dtypes = {p.column: df.schema[p.column].dataType for p in positions}
    names = list(dtypes)
    counts: list[Count] = []
    for k, name in enumerate(names):
        mine = {(p.prefix, p.known_bits): p.inside for p in positions if p.column == name}
        left = key_bits(dtypes[name]) - min(known for _, known in mine)
        few = sum(mine.values()) <= listed_values and left <= LISTED_BITS
        counts += [Count(k, prefix, known, left if few else DIGIT_BITS) for prefix, known in mine]
    number = {(names[c.column], c.prefix, c.known_bits): i for i, c in enumerate(counts)}
    of = [number[p.column, p.prefix, p.known_bits] for p in positions]
    asked = df.sparkSession.createDataFrame(
        [(j, i, p.at - p.below) for j, (i, p) in enumerate(zip(of, positions, strict=True))], "position int, count int, at bigint"
    )
    upto = Window.partitionBy("count").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    placed = _counted(df, names, counts).withColumn("last", F.sum("n").over(upto)).withColumn("first", F.col("last") - F.col("n"))
    # One row for each position, whatever the number of rows.
    found = placed.join(F.broadcast(asked), "count").where("first <= at AND at < last").select("position", "digit", "first", "n")
    out = list(positions)
    for r in found.collect():
        p, c = positions[r.position], counts[of[r.position]]
        out[r.position] = replace(
            p, prefix=p.prefix << c.bits | r.digit, known_bits=p.known_bits + c.bits, below=p.below + r.first, inside=r.n
        )
    return out


def column_ranges(df: DataFrame, names: list[str]) -> dict[str, tuple[int, object, object]]:
    """Values, smallest and largest value of each column."""
    facts = []
    for name in names:
        value = present(df, name)
        facts += [F.count(value), F.min(value), F.max(value)]
    row = aggregate_values(df, facts) if facts else []
    return {name: tuple(row[3 * i : 3 * i + 3]) for i, name in enumerate(names)}


def order_statistics(
    df: DataFrame, wanted: dict[str, list[int]], ranges: dict[str, tuple] | None = None, listed_values: int = LISTED_VALUES
) -> dict[tuple[str, int], object]:
    """The values at the wanted places (from 0) of each column's order, NULL and NaN left out.

    Exact at any size and in the column's own type. Columns are numbers; places must be
    within the number of values. `ranges` are those of `column_ranges`, if known.
    """
    ranges = ranges or column_ranges(df, list(wanted))
    positions: list[Position] = []
    for name, places in wanted.items():
        n, low, high = ranges[name]
        dtype = df.schema[name].dataType
        bits, first, last = key_bits(dtype), *((key_of(x, dtype) for x in (low, high)) if n else (0, 0))
        shared = bits - (first ^ last).bit_length()
        shared = bits if first == last else shared // DIGIT_BITS * DIGIT_BITS
        positions += [Position(name, at, first >> (bits - shared), shared, 0, n) for at in sorted(set(places))]

    def known(p: Position) -> bool:
        return p.known_bits == key_bits(df.schema[p.column].dataType)

    while not all(map(known, positions)):
        ready = [p for p in positions if known(p)]
        open_ = [p for p in positions if not known(p)]
        positions = ready + [p for some in _passes(open_) for p in _longer(df, some, listed_values)]
    return {(p.column, p.at): value_of(p.prefix, df.schema[p.column].dataType) for p in positions}


def _passes(positions: list[Position]) -> Iterator[list[Position]]:
    """The positions of some columns at a time, so that the counts fit a task."""
    names = list(dict.fromkeys(p.column for p in positions))
    prefixes = {name: len({p.prefix for p in positions if p.column == name}) for name in names}
    for some in chunked(names, max(1, PREFIXES_PER_PASS // max(prefixes.values()))):
        yield [p for p in positions if p.column in some]
