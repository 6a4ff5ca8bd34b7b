"""The most frequent values from mergeable summaries, proved by an exact count of few candidates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.profiling.columns import FLOATING, present

# Values that a task's summary of a column holds, for each value wanted and at least.
HELD_PER_WANTED, HELD_AT_LEAST = 50, 500
# Candidates that are counted exactly, for each value wanted.
CANDIDATES_PER_WANTED = 10
# Values that wait before a summary is cut, and the bytes that it may hold.
WAITING = 1 << 16
SUMMARY_BYTES = 8 << 20

SUMMARY_SCHEMA = "id int, text string, whole bigint, real double, n bigint, error bigint"
KINDS = {"text": pa.string(), "whole": pa.int64(), "real": pa.float64()}


class Summary:
    """Counts of the frequent values of a column, each too low by `error` at most.

    Whenever there are more than `most` values, the count of the first one beyond is taken
    off all counts and what is left without one is dropped (after Misra and Gries).
    """

    def __init__(self, most: int, dtype: pa.DataType = KINDS["text"]) -> None:
        self.most, self.error = most, 0
        self.values, self.counts = pa.array([], dtype), np.empty(0, np.int64)
        self.waiting: list[tuple[pa.Array, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, column: pa.Array) -> None:
        found = pc.value_counts(column.drop_null())
        self.waiting.append((found.field("values"), found.field("counts").to_numpy(zero_copy_only=False)))
        self.n_waiting += len(found)
        if self.n_waiting > WAITING or sum(v.nbytes for v, _ in self.waiting) > SUMMARY_BYTES:
            self.cut()

    def cut(self) -> None:
        values = pa.concat_arrays([self.values, *(v for v, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        both = pa.table({"v": values, "n": counts}).group_by("v").aggregate([("n", "sum")])
        self.values, self.counts = both.column("v").combine_chunks(), both.column("n_sum").to_numpy().astype(np.int64)
        self.waiting, self.n_waiting = [], 0
        most = self.most
        while len(self.counts) > most or (len(self.counts) > 1 and self.values.nbytes > SUMMARY_BYTES):
            # Of long values fewer are held.
            most = most if len(self.counts) > most else len(self.counts) // 2
            off = int(np.partition(self.counts, -most - 1)[-most - 1])
            kept = self.counts > off
            self.values, self.counts = self.values.filter(pa.array(kept)), self.counts[kept] - off
            self.error += off


class Found(NamedTuple):
    """Proved rows (column, value, n), and the columns without a proof."""

    rows: list[tuple[str, str, int]]
    unproved: list[str]


def as_text(df: DataFrame, name: str) -> Column | None:
    """A column's values as text that tells them apart, NULL where missing; None for types without such."""
    dtype, value = df.schema[name].dataType, present(df, name)
    if isinstance(dtype, FLOATING):
        return (value + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, T.StringType):
        return value if dtype.simpleString() == "string" else None
    plain = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampNTZType, T.BooleanType)
    return value.cast("string") if isinstance(dtype, plain) else None


def _countable(df: DataFrame, name: str) -> tuple[str, Column] | None:
    """A column's values as they are counted, and their kind: whole numbers and doubles are made text only where listed."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return "whole", present(df, name).cast("bigint")
    if isinstance(dtype, T.DoubleType):
        return "real", present(df, name) + F.lit(0.0)
    text = as_text(df, name)
    return None if text is None else ("text", text)


def frequent_values(df: DataFrame, names: list[str], k: int) -> Found:
    """The `k` most frequent values of each column, ties broken by the value as text, where that can be proved.

    Every task hands on a summary of bounded size for each column, and the sum of the
    summaries names some candidates, which a second pass counts exactly. No other value can
    be more frequent than the first one left out plus the sum of the summaries' errors; if
    the k-th candidate is, its place is proved. Columns of so few values that no summary was
    cut need no second pass. Others come back as `unproved`.
    """
    values = {name: _countable(df, name) for name in names}
    known = [name for name in names if values[name] is not None]
    unproved = [name for name in names if values[name] is None]
    if not known:
        return Found([], unproved)
    kinds = [values[name][0] for name in known]
    most, wanted = max(HELD_PER_WANTED * k, HELD_AT_LEAST), CANDIDATES_PER_WANTED * k

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = [Summary(most, KINDS[kind]) for kind in kinds]
        for batch in batches:
            for summary, column in zip(summaries, batch.columns, strict=True):
                summary.add(column)
        for i, (summary, kind) in enumerate(zip(summaries, kinds, strict=True)):
            summary.cut()
            size = len(summary.counts) + 1
            found = {of: pa.nulls(size, dtype) for of, dtype in KINDS.items()}
            found[kind] = pa.concat_arrays([summary.values, pa.array([None], KINDS[kind])])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(np.full(size, i, np.int32)), **found, "n": pa.array(np.append(summary.counts, 0)),
                    "error": pa.array(np.append(np.zeros(size - 1, np.int64), summary.error)),
                }
            )

    columns = df.select(*[values[name][1].alias(f"c{i}") for i, name in enumerate(known)])
    summed = columns.mapInArrow(summarise, SUMMARY_SCHEMA).groupBy("id", *KINDS).agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    summed = summed.withColumn("value", F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string")))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("value").isNotNull(), F.col("n").desc(), "value"))
    # The error, the candidates and the first value left out: a bounded number of rows.
    listed = summed.withColumn("place", place).where(F.col("place") <= wanted + 2).collect()
    error = {r.id: r.error for r in listed if r.value is None}
    counted_as = {(r.id, r.value): r[kinds[r.id]] for r in listed}
    ranked = {i: sorted(((-r.n, r.value) for r in listed if r.id == i and r.value is not None)) for i in range(len(known))}
    rows, candidates = [], []
    for i, name in enumerate(known):
        if error.get(i, 0) == 0:
            rows += [(name, value, -n) for n, value in ranked[i][:k]]
        else:
            candidates += [(i, value) for _, value in ranked[i][:wanted]]
    counted = _exact_counts(columns, kinds, candidates, counted_as)
    for i, name in enumerate(known):
        if error.get(i, 0) == 0:
            continue
        exact = sorted((-n, value) for (j, value), n in counted.items() if j == i)
        limit = (-ranked[i][wanted][0] if len(ranked[i]) > wanted else 0) + error[i]
        if len(exact) >= k and -exact[k - 1][0] > limit:
            rows += [(name, value, -n) for n, value in exact[:k]]
        else:
            unproved.append(name)
    return Found(rows, unproved)


def _exact_counts(columns: DataFrame, kinds: list[str], candidates: list[tuple[int, str]], counted_as: dict) -> dict[tuple[int, str], int]:
    if not candidates:
        return {}
    asked: dict[int, list[str]] = {}
    for i, value in candidates:
        asked.setdefault(i, []).append(value)
    looked_up = {i: pa.array([counted_as[i, value] for value in found], KINDS[kinds[i]]) for i, found in asked.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros(len(found), np.int64) for i, found in looked_up.items()}
        for batch in batches:
            for column, (i, found) in zip(batch.columns, looked_up.items(), strict=True):
                at = pc.index_in(column, value_set=found).drop_null().to_numpy(zero_copy_only=False)
                totals[i] += np.bincount(at, minlength=len(found))
        for i, n in totals.items():
            yield pa.RecordBatch.from_pydict({"id": pa.array(np.full(len(n), i, np.int32)), "at": pa.array(np.arange(len(n))), "n": pa.array(n)})

    counts = columns.select(*[f"c{i}" for i in looked_up]).mapInArrow(count, "id int, at bigint, n bigint")
    return {(r.id, asked[r.id][r.at]): r.n for r in counts.groupBy("id", "at").agg(F.sum("n").alias("n")).collect()}


def smallest_texts(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """The `k` smallest values of each column as text, once each value is known to occur once."""
    texts = [F.struct(F.lit(name).alias("column"), as_text(df, name).alias("value")) for name in names]
    long = df.select(F.inline(F.array(*texts))).where("value IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return long.withColumn("place", place).where(F.col("place") <= k).select("column", "value", F.lit(1).cast("bigint").alias("n"))
