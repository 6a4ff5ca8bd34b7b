"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path

# Spark may broadcast what is measured to be within this many bytes.
BROADCAST_BYTES = 32 << 20


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_ROWS, TEXT_ROWS = "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers 1,000 at a time, unless the session says otherwise.

    The default of 10,000 is meant for narrow rows; of texts they are tens of megabytes.
    """
    if spark.conf.get(ARROW_ROWS) == DEFAULT_ROWS:
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)


_SCOPES: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside, but for those to be kept, when the block ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    What is read has no lineage behind it, so a lost executor costs only the
    reading of a file again, and nothing nondeterministic is computed twice.
    """
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, created."""
    path = scratch_path(spark, label)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    return path


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table made by `written` once nothing reads it any more."""
    spark = df.sparkSession
    for parent in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        _delete(spark, parent)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df`, hinted for broadcast if its rows of at most `row_bytes` fit BROADCAST_BYTES; give a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
