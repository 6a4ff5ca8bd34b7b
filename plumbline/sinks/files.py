"""Writing file datasets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.sizing import COLLECT_LIMIT_BYTES, Size, dataset_size
from plumbline.sinks.tables import as_spark

# Fixed options: quotes doubled inside quotes, blanks kept, a header line.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(
    spark: SparkSession, df: object, path: str, mode: str = "overwrite", **options: object
) -> None:
    """Write a frame as delimited text with a header line and no index."""
    as_spark(spark, df).write.mode(mode).options(**{**CSV_OPTIONS, **options}).csv(path)


def export(
    df: DataFrame,
    path: str,
    target_file_bytes: int = COLLECT_LIMIT_BYTES,
    size: Size | None = None,
    fmt: str = "parquet",
    mode: str = "overwrite",
    rebalance: bool = False,
) -> int:
    """Write `df` as files of about `target_file_bytes` modelled bytes; returns the least file count.

    Data that fits one file is gathered into one after the upstream work has run
    in parallel. Larger data is written by the tasks that hold it, each starting a
    new file at the row limit, so nothing is shuffled; `rebalance` evens out many
    small input partitions first.
    """
    if target_file_bytes < 1:
        raise ValueError(f"target_file_bytes must be positive, got {target_file_bytes}")
    rows, total = dataset_size(df, "wire") if size is None else size
    files = max(1, math.ceil(total / target_file_bytes))
    if files == 1:
        out = df.repartition(1)
    else:
        out = df.hint("rebalance") if rebalance else df
    writer = out.write.format(fmt).mode(mode)
    if files > 1:
        writer = writer.option("maxRecordsPerFile", max(1, math.ceil(rows / files)))
    writer.save(path)
    return files
