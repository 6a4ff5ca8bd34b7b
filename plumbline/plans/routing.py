"""Reading a table or a path into the kind of frame its size allows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from plumbline.operators.reduction import METHODS, reduce_to_budget, row_limit
from plumbline.operators.sizing import COLLECT_LIMIT_BYTES, dataset_size, is_oversized
from plumbline.session import ARROW, session_setting
from plumbline.sources.files import read_files, read_surveyed
from plumbline.sources.inventory import survey_path, total_bytes


def _collect(df: DataFrame) -> pd.DataFrame:
    with session_setting(df.sparkSession, ARROW, "true"):
        return df.toPandas()


def _collect_within(df: DataFrame, method: str, threshold_bytes: int) -> pd.DataFrame:
    size = dataset_size(df)
    if method == "limit" and size.bytes > threshold_bytes:
        # Without Arrow a limited frame is collected as `take` does it, by only as many
        # tasks as it needs rows, and the rows pass through the driver once.
        with session_setting(df.sparkSession, ARROW, "false"):
            return df.limit(row_limit(size.rows, size.bytes, threshold_bytes)).toPandas()
    return _collect(reduce_to_budget(df, method, size.bytes, threshold_bytes))


def _on_spark(df: DataFrame, index_col: str | list[str] | None):
    """pandas on Spark; without an index column, numbers that need no pass over the rows."""
    import pyspark.pandas as ps  # slow to load, and needed here alone

    with ps.option_context("compute.default_index_type", "distributed"):
        return df.pandas_api(index_col=index_col)


def _route(
    df: DataFrame,
    oversized: bool,
    threshold_bytes: int,
    force_pandas: bool,
    force_method: str,
    index_col: str | list[str] | None,
):
    if not oversized:
        return _collect(df)
    if force_pandas:
        return _collect_within(df, force_method, threshold_bytes)
    return _on_spark(df, index_col)


def _check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")


def read_from_table(
    spark: SparkSession,
    table_name: str,
    as_pandas: bool = False,
    threshold_bytes: int = COLLECT_LIMIT_BYTES,
    force_pandas: bool = False,
    force_method: str = "sample",
    index_col: str | list[str] | None = None,
):
    """Read a catalog table.

    | request                     | within threshold | over threshold         |
    | --------------------------- | ---------------- | ---------------------- |
    | default                     | Spark            | Spark                  |
    | `as_pandas`                 | pandas           | pandas on Spark        |
    | `as_pandas`, `force_pandas` | pandas           | pandas, reduced to fit |

    `force_method` reduces by `sample` or by `limit`. `index_col` names the index of a
    pandas-on-Spark result; without it the index is unique numbers in no order.
    """
    _check_method(force_method)
    df = spark.read.table(table_name)
    if not as_pandas:
        return df
    oversized = is_oversized(df, threshold_bytes=threshold_bytes)
    return _route(df, oversized, threshold_bytes, force_pandas, force_method, index_col)


def read_from_path(
    spark: SparkSession,
    path: str,
    as_pandas: bool = False,
    threshold_bytes: int = COLLECT_LIMIT_BYTES,
    force_pandas: bool = False,
    force_method: str = "sample",
    filetype: str | None = None,
    schema: StructType | str | None = None,
    index_col: str | list[str] | None = None,
    **options: object,
):
    """Read a file dataset whose format is taken from its listing.

    The outcomes are those of `read_from_table`. The files' bytes are compared
    with the threshold first; files within it may still unpack to more, so their
    modelled memory is checked before anything is collected.
    """
    _check_method(force_method)
    if filetype is None:
        survey = survey_path(spark, path)
        n_bytes, df = survey.n_bytes, read_surveyed(spark, path, survey, schema, **options)
    else:
        n_bytes = total_bytes(spark, path) if as_pandas else 0
        df = read_files(spark, path, filetype, schema, **options)
    if not as_pandas:
        return df
    oversized = n_bytes > threshold_bytes or is_oversized(df, threshold_bytes=threshold_bytes)
    return _route(df, oversized, threshold_bytes, force_pandas, force_method, index_col)
