"""Adding rounded timestamp columns, the time half of a feature-join key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from plumbline.functions.timegrid import ceil_to_grid


def round_timestamps(
    df: DataFrame,
    grids: Mapping[str, tuple[str, int] | list[tuple[str, int]]],
    view: str | None = None,
) -> DataFrame:
    """Replace timestamp columns by versions rounded up to a grid.

    `grids` maps a source column to (new column, minutes), or to a list of such
    pairs when one column feeds several grids. The sources are dropped. The whole
    step is one projection. With `view`, the result is also published as a
    temporary view.
    """
    rounded = {}
    for source, targets in grids.items():
        for name, minutes in [targets] if isinstance(targets, tuple) else targets:
            if name in rounded:
                raise ValueError(f"column {name!r} is given twice")
            rounded[name] = ceil_to_grid(df[source], minutes)
    dropped = [source for source in grids if source not in rounded]
    result = df.withColumns(rounded).drop(*dropped)
    if view is not None:
        result.createOrReplaceTempView(view)
    return result
