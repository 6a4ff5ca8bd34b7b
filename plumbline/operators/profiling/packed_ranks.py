"""Ranks of columns with many different values, without moving rows once per column.

A block is a run of rows of one input partition. It asks the ranges of each column for the
ranks of its different values, sorted and packed, and keeps its rows as places among them.
A range answers in the block's own order, so that an answer needs no values. However many
rows hold a value, it is one entry per block, and a row is moved once, not once per column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.profiling.columns import aggregate_values
from plumbline.session import stored

# Cells of a block, and the rows that a range of a column stands for, about.
BLOCK_CELLS = 1 << 23
RANGE_ROWS = 1 << 21

# With range -1: `n` rows as places among `total` values, and the ranks of these if no range is asked for them.
# Else `n` values: asked for, with their counts, or their doubled ranks. `total` is the sum of the counts.
_PACKED = "block bigint, column int, range int, n bigint, total bigint, packed binary, more binary"
_PACKED_ARROW = pa.schema(
    [("block", pa.int64()), ("column", pa.int32()), ("range", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("packed", pa.binary()), ("more", pa.binary())]
)


def pack(values: np.ndarray) -> bytes:
    """Numbers of a fixed width, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, dtype: type, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64, n), dtype=np.uint64)


def order_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of some longs or doubles; equal for equal values, -0.0 and 0.0 among them."""
    top = np.uint64(1 << 63)
    if values.dtype.kind == "f":
        bits = (values + 0.0).view(np.uint64)
        return np.where(bits >= top, ~bits, bits | top)
    return values.astype(np.int64).view(np.uint64) ^ top


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _ask(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    """Rows as places among the different values of their block, and what it asks; nothing for columns without cuts."""
    part = TaskContext.get().partitionId()
    for number, table in enumerate(_blocks(batches, max(1, BLOCK_CELLS // len(cuts)))):
        block = (part << 32) | number
        for i, cut in enumerate(cuts):
            column = table.column(i).combine_chunks()
            missing = column.is_null().to_numpy(zero_copy_only=False)
            values = column.drop_null().to_numpy(zero_copy_only=False)
            keys = values if cut is None else order_keys(values)
            distinct, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
            places = np.full(len(missing), -1, np.int32)
            places[~missing] = of
            out = [(block, i, -1, len(places), len(distinct), pack(places), pack(distinct) if cut is None else None)]
            if cut is not None:
                bounds = [0, *np.searchsorted(distinct, cut).tolist(), len(distinct)]
                for r, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if b > a:
                        out.append((block, i, r, b - a, int(counts[a:b].sum()), pack_sorted(distinct[a:b]), pack(counts[a:b].astype(np.int32))))
            yield _packed(out).to_batches()[0]


def _packed(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pydict({n: [row[k] for row in rows] for k, n in enumerate(_PACKED_ARROW.names)}, schema=_PACKED_ARROW)


def _answers(past: dict[tuple[int, int], int]) -> Callable:
    """Of a range: the doubled ranks of the values that each block asks for."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        column, place = (k.as_py() for k in key)
        rows = table.select(["block", "n", "packed", "more"]).to_pylist()
        counts = np.concatenate([unpack(r["more"], np.int32, r["n"]) for r in rows])
        _, of = np.unique(np.concatenate([unpack_sorted(r["packed"], r["n"]) for r in rows]), return_inverse=True)
        n = np.bincount(of, weights=counts).astype(np.int64)
        doubled = (2 * (past[column, place] + np.cumsum(n) - n) + n + 1).astype(np.uint64)[of]
        parts = np.split(doubled, np.cumsum([r["n"] for r in rows])[:-1])
        return _packed([(r["block"], column, place, r["n"], 0, pack_sorted(p), None) for r, p in zip(rows, parts, strict=True)])

    return answer


def _filled(names: list[str]) -> Callable:
    """The rows of a block with the ranks that it was told."""
    schema = pa.schema([(name, pa.float64()) for name in names])

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["block"]).to_pylist(), key=lambda r: (r["column"], r["range"]))
        columns = []
        for i in range(len(names)):
            own, *told = [r for r in rows if r["column"] == i]
            if own["more"] is not None:
                ranks = unpack(own["more"], np.float64, own["total"])
            else:
                ranks = np.concatenate([np.empty(0), *(unpack_sorted(r["packed"], r["n"]) / 2 for r in told)])
            places = unpack(own["packed"], np.int32, own["n"])
            # Place -1, of a missing value, takes the number put at the end.
            columns.append(pa.array(np.append(ranks, 0.0)[places], mask=places < 0))
        return pa.Table.from_arrays(columns, schema=schema)

    return fill


def _grouped(df: DataFrame, *keys: str):
    """Rows of equal keys together, dealt to all shuffle partitions: packed rows are few bytes and much work."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys).groupBy(*keys)


def packable(dtype: T.DataType) -> bool:
    """Whether values have an order among 64-bit numbers."""
    return not isinstance(dtype, T.DecimalType) or dtype.precision <= 18


def _as_number(df: DataFrame, name: str):
    """A column as longs or doubles in the same order; a decimal by its digits."""
    dtype, value = df.schema[name].dataType, F.col(name)
    if isinstance(dtype, T.DecimalType):
        return (value * F.lit(10**dtype.scale).cast(T.DecimalType(dtype.scale + 1, 0))).cast("bigint").alias(name)
    return value.cast("bigint" if isinstance(dtype, T.IntegralType) else "double").alias(name)


def put_ranks(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """`rows`, whose columns are numbers, with the columns of `counts` replaced by their average ranks.

    `counts` has the present values of a column, about; NULL stays NULL and NaN is not
    looked for. The other columns are doubles and stay as they are.
    """
    names = rows.columns
    numbers = rows.select(*[_as_number(rows, name) for name in names])
    wanted = [name for name in names if counts.get(name, 0) > RANGE_ROWS]
    found = {}
    if wanted:
        shares = [-(-counts[name] // RANGE_ROWS) for name in wanted]
        points = [F.array(*[F.lit(k / n) for k in range(1, n)]) for n in shares]
        asked = [F.percentile_approx(name, p, F.lit(100 * n)) for name, p, n in zip(wanted, points, shares, strict=True)]
        found = dict(zip(wanted, aggregate_values(numbers, asked), strict=True))
    cuts: list[np.ndarray | None] = []
    for name in names:
        dtype = np.int64 if isinstance(numbers.schema[name].dataType, T.LongType) else np.float64
        cuts.append(np.unique(order_keys(np.array(found.get(name) or [], dtype))) if name in counts else None)
    asked = stored(numbers.mapInArrow(lambda batches: _ask(batches, cuts), _PACKED), "asked-ranks")
    questions = asked.where("range >= 0")
    past, begin = {}, {}
    for r in sorted(questions.groupBy("column", "range").agg(F.sum("total").alias("total")).collect()):
        past[r.column, r.range] = begin.get(r.column, 0)
        begin[r.column] = past[r.column, r.range] + r.total
    answers = _grouped(questions, "column", "range").applyInArrow(_answers(past), _PACKED)
    told = asked.where("range < 0").unionByName(answers)
    ddl = ", ".join(f"{name} double" for name in names)
    return _grouped(told, "block").applyInArrow(_filled(names), ddl)
