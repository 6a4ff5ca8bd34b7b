"""How large a dataset is, as rows and modelled bytes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rowbytes import row_bytes, row_width

# Fixed value: the most bytes a driver collects unless told otherwise (128 MiB).
COLLECT_LIMIT_BYTES = 128 * 1024 * 1024
PROBE_ROWS = 10_000


class Size(NamedTuple):
    rows: int
    bytes: int


def measure(df: DataFrame, layout: str = "pandas") -> DataFrame:
    """One row (n_rows, n_bytes) from one aggregation without a data shuffle.

    Only variable-width columns are read; a table of fixed-width columns is
    sized from its row count alone.
    """
    constant, varying = row_width(df.schema, layout)
    rows = F.count(F.lit(1))
    size = rows * F.lit(constant).cast("bigint")
    if varying is not None:
        size = size + F.coalesce(F.sum(varying), F.lit(0))
    return df.agg(rows.alias("n_rows"), size.alias("n_bytes"))


def dataset_size(df: DataFrame, layout: str = "pandas") -> Size:
    """Exact row count and modelled bytes; an empty frame has size 0."""
    return Size(*measure(df, layout).first())


def estimate_size(
    df: DataFrame, probe_rows: int = PROBE_ROWS, layout: str = "pandas", seed: int | None = None
) -> float:
    """Modelled bytes from the row count and the mean width of about `probe_rows` sampled rows."""
    rows = df.count()
    if rows == 0:
        return 0.0
    probe = df.sample(fraction=min(1.0, probe_rows / rows), seed=seed)
    mean = probe.agg(F.avg(row_bytes(df.schema, layout))).first()[0]
    return rows * mean if mean is not None else float(dataset_size(df, layout).bytes)


def is_oversized(
    df: DataFrame,
    size: float | None = None,
    threshold_bytes: int = COLLECT_LIMIT_BYTES,
    layout: str = "pandas",
) -> bool:
    """Whether the dataset is strictly larger than the threshold.

    The constant part of the row width gives a lower bound from the row count
    alone, which file footers answer. A large table is recognised by that bound;
    only a table of few enough rows has its values read.
    """
    if size is not None:
        return size > threshold_bytes
    constant, varying = row_width(df.schema, layout)
    if df.count() * constant > threshold_bytes:
        return True
    return varying is not None and dataset_size(df, layout).bytes > threshold_bytes
