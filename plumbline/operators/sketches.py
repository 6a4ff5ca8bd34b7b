"""Quantile sketches merged in two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sketch size parameter; the rank error is below 0.1% of the rows, three times
# that leaves room for an unlucky draw.
SKETCH_K = 4096
RANK_ERROR = 0.001
SAFE_MARGIN = 3 * RANK_ERROR
# Tasks whose sketches are merged together before the final merge.
MERGE_GROUPS = 512


def quantile_sketches(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """One row with a sketch `s0`, `s1`, ... per double-valued column.

    Each task sketches its rows. A one-step aggregation would hand the sketches
    of all tasks to a single one; here up to MERGE_GROUPS tasks each merge a
    share of them first.
    """
    named = {f"s{i}": value.cast("double") for i, value in enumerate(values)}
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("merge_group")
    per_group = (
        df.select(group, *[value.alias(name) for name, value in named.items()])
        .groupBy("merge_group")
        .agg(*[F.kll_sketch_agg_double(name, F.lit(SKETCH_K)).alias(name) for name in named])
    )
    return per_group.agg(*[F.kll_merge_agg_double(name).alias(name) for name in named])


def quantile_of(sketch: Column | str, shares: Sequence[float]) -> Column:
    """Values at the given shares of the rows, NULL for a sketch without values."""
    sketch = F.col(sketch) if isinstance(sketch, str) else sketch
    points = F.array(*[F.lit(min(1.0, max(0.0, float(share)))) for share in shares])
    return F.when(
        F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, points)
    )
