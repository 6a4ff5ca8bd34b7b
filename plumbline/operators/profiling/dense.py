"""Counts of bucket numbers as dense arrays in each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profiling.columns import chunked, union_all

# Cells counted in one pass: 32 MB of counts in a task.
CELLS_PER_PASS = 1 << 22
COUNTS_SCHEMA = "id int, cell bigint, n bigint"


def cell_counts(df: DataFrame, buckets: list[Column], groups: list[tuple[int, ...]], bins: int) -> DataFrame:
    """Rows per (`id`, `cell`) of every group of columns, cells without rows left out.

    `buckets` are bucket numbers from 1 to `bins` or NULL; a group names the columns whose
    numbers are counted together, `cell` being their numbers from 0 in a mixed base of
    `bins`, the first column most significant. A row counts for a group where all are
    present. Each task counts whole batches into one array per group, and hands on at most
    a row per cell, whatever its number of rows; the arrays are merged by sums.
    """
    per_group = max((bins + 1) ** len(g) for g in groups)
    parts = []
    for at, some in enumerate(chunked(groups, max(1, CELLS_PER_PASS // per_group))):
        first = at * max(1, CELLS_PER_PASS // per_group)
        parts.append(_pass(df, buckets, some, bins).withColumn("id", F.col("id") + F.lit(first)))
    return union_all(parts)


def _pass(df: DataFrame, buckets: list[Column], groups: list[tuple[int, ...]], bins: int) -> DataFrame:
    used = sorted({c for g in groups for c in g})
    place = {c: k for k, c in enumerate(used)}
    # 0 stands for a missing number.
    numbers = df.select(*[F.coalesce(buckets[c], F.lit(0)).cast("int").alias(f"b{k}") for k, c in enumerate(used)])
    base = bins + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(base ** len(g), dtype=np.int64) for g in groups]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            for total, group in zip(counts, groups, strict=True):
                cell = columns[place[group[0]]]
                for c in group[1:]:
                    cell = cell * base + columns[place[c]]
                found = np.bincount(cell)
                total[: len(found)] += found
        for i, (total, group) in enumerate(zip(counts, groups, strict=True)):
            whole = total.reshape([base] * len(group))[(slice(1, None),) * len(group)].ravel()
            cells = np.flatnonzero(whole)
            yield pa.RecordBatch.from_pydict(
                {"id": pa.array(np.full(len(cells), i, np.int32)), "cell": pa.array(cells), "n": pa.array(whole[cells])}
            )

    return numbers.mapInArrow(count, COUNTS_SCHEMA).groupBy("id", "cell").agg(F.sum("n").alias("n"))
