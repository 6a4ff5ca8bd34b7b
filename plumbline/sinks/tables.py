"""Writing catalog tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.names import quoted
from plumbline.session import ARROW, session_setting

# Where a name with fewer than three parts belongs.
DEFAULT_CATALOG = "spark_catalog"
DEFAULT_SCHEMA = "default"

OVERWRITE_PARTITIONS = "overwrite_partitions"


class TableName(NamedTuple):
    catalog: str
    schema: str
    table: str


def split_table_name(name: str) -> TableName:
    """Split `table`, `schema.table` or `catalog.schema.table`; anything else is an error."""
    parts = name.split(".")
    if len(parts) > 3 or any(not part.strip() or "`" in part for part in parts):
        raise ValueError(f"invalid table name {name!r}: give one to three plain parts")
    defaults = (DEFAULT_CATALOG, DEFAULT_SCHEMA)
    return TableName(*defaults[: 3 - len(parts)], *parts)


def create_schema(
    spark: SparkSession,
    schema: str,
    catalog: str = DEFAULT_CATALOG,
    location: str | None = None,
) -> None:
    """Create a schema unless it is there, optionally in a given folder."""
    where = "" if location is None else " LOCATION '{}'".format(location.replace("'", "\\'"))
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{catalog}`.`{schema}`{where}")


def as_spark(spark: SparkSession, df: object) -> DataFrame:
    """A Spark frame from a Spark, pandas or pandas-on-Spark one."""
    if isinstance(df, pd.DataFrame):
        with session_setting(spark, ARROW, "true"):
            return spark.createDataFrame(df)
    if hasattr(df, "to_spark"):
        return df.to_spark()
    return df


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    """The partition columns of an existing table, none if it does not exist."""
    if not spark.catalog.tableExists(name):
        return []
    return [column.name for column in spark.catalog.listColumns(name) if column.isPartition]


def save_as_table(
    spark: SparkSession,
    df: object,
    table_name: str,
    mode: str = "append",
    table_properties: Mapping[str, object] | None = None,
    create_requirements: bool = False,
    rebalance: bool = True,
) -> None:
    """Save a frame as a catalog table.

    Beside Spark's modes there is `overwrite_partitions`: the partitions that the frame has
    rows for are replaced and all others stay. Spark stages the files and moves them when
    all are written, so a job that fails before leaves the table as it was, and one run
    again gives the same table. A table that isn't there is created.

    `partitionBy` in `table_properties` names the partition columns; an append
    without it keeps the layout the table has. All other entries are writer
    options. `create_requirements` creates the schema first.

    A partitioned write is rebalanced on its partition columns, so a partition
    value is written by few tasks and a value holding much of the data is split
    over several; `rebalance=False` writes each task's rows where they are.
    """
    name = split_table_name(table_name)
    df = as_spark(spark, df)
    options = dict(table_properties or {})
    layout = options.pop("partitionBy", None) or []
    layout = [layout] if isinstance(layout, str) else list(layout)
    if create_requirements:
        create_schema(spark, schema=name.schema, catalog=name.catalog)
    replace = mode == OVERWRITE_PARTITIONS and spark.catalog.tableExists(table_name)
    if mode == OVERWRITE_PARTITIONS:
        has = partition_columns(spark, table_name)
        if replace and (not has or layout not in ([], has)):
            raise ValueError(f"{table_name!r} is partitioned by {has}, not by {layout}")
        layout = layout or has
        if not layout:
            raise ValueError(f"name the partition columns of {table_name!r}")
    if not layout and mode == "append":
        layout = partition_columns(spark, table_name)
    if layout and rebalance:
        df = df.hint("rebalance", *layout)
    if replace:
        # Rows are inserted by position, the partition columns last.
        names = spark.table(table_name).columns
        if sorted(names) != sorted(df.columns):
            raise ValueError(f"{table_name!r} has columns {names}, the rows {df.columns}")
        writer = df.select(*[quoted(name) for name in names]).write.options(**options)
        with session_setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            writer.insertInto(table_name, overwrite=True)
        return
    writer = df.write.mode("errorifexists" if mode == OVERWRITE_PARTITIONS else mode).options(**options)
    if layout:
        writer = writer.partitionBy(*layout)
    writer.saveAsTable(table_name)
