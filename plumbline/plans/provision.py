"""Putting one example table into several environments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.timestamps import round_timestamps
from plumbline.session import shared_folder
from plumbline.sinks.tables import DEFAULT_CATALOG, create_schema, save_as_table

# The share and seed of an example table.
EXAMPLE_FRACTION = 0.01
EXAMPLE_SEED = 1


def example_table(
    df: DataFrame,
    grids: Mapping[str, tuple[str, int] | list[tuple[str, int]]],
    fraction: float = EXAMPLE_FRACTION,
    seed: int = EXAMPLE_SEED,
    view: str | None = None,
) -> DataFrame:
    """A seeded sample of `df` with its timestamps rounded to their grids."""
    return round_timestamps(df.sample(fraction=fraction, seed=seed), grids, view)


def provision(
    spark: SparkSession,
    df: DataFrame,
    environments: Sequence[str],
    schema: str,
    table: str,
    mode: str = "errorifexists",
    catalogs: bool = False,
    location: str | None = None,
) -> list[str]:
    """Write the same table into every environment and return the table names.

    A table that exists already is an error unless `mode` says `overwrite` or `append`.

    With `catalogs` an environment is a catalog of the session; otherwise it is
    the schema `<environment>_<schema>` of the default catalog, which holds one
    level of schemas. The frame is computed once: through a checkpoint where the
    session has a folder for it, so a lost executor cannot change the rows between
    two environments, else through a cache that is released at the end.
    """
    reliable = shared_folder(spark) is not None
    shared = df.checkpoint() if reliable else df.persist(StorageLevel.MEMORY_AND_DISK)
    names = []
    try:
        for environment in environments:
            catalog = environment if catalogs else DEFAULT_CATALOG
            namespace = schema if catalogs else f"{environment}_{schema}"
            folder = None if location is None else f"{location.rstrip('/')}/{catalog}/{namespace}"
            create_schema(spark, schema=namespace, catalog=catalog, location=folder)
            name = f"{catalog}.{namespace}.{table}"
            save_as_table(spark, shared, name, mode=mode)
            names.append(name)
    finally:
        if not reliable:
            shared.unpersist()
    return names
