"""Correlations of many columns in one scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profiling.columns import aggregate_values, finite_number

SUMS_SCHEMA = (
    "a int, b int, n double, sum_a double, sum_b double, "
    "sum_aa double, sum_bb double, sum_ab double"
)
# Below this share of the sum of squares the spread has lost digits; with it, 1e-10 are left.
LEAST_SPREAD = 1e-5
CORRELATION_SCHEMA = "column_a string, column_b string, correlation double"


def pair_sums(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Sums per column pair over one task's rows with both values present, as matrix products."""
    both, first, square, product = (np.zeros((width, width)) for _ in range(4))
    for batch in batches:
        values = batch.to_numpy(dtype="float64")
        held = ~np.isnan(values)
        values, held = np.where(held, values, 0.0), held.astype("float64")
        both += held.T @ held
        first += values.T @ held
        square += (values * values).T @ held
        product += values.T @ values
    a, b = np.triu_indices(width, k=1)
    yield pd.DataFrame(
        {
            "a": a.astype("int32"),
            "b": b.astype("int32"),
            "n": both[a, b],
            "sum_a": first[a, b],
            "sum_b": first[b, a],
            "sum_aa": square[a, b],
            "sum_bb": square[b, a],
            "sum_ab": product[a, b],
        }
    )


def matrix_correlations(
    df: DataFrame, names: list[str]
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Pearson correlation of every pair of `names` from one scan, and the pairs it can't tell.

    Each task hands on one row per pair, whatever its number of rows, and the driver
    gets one per pair. Values are shifted by the column mean first, so the sums keep
    their digits. What they can't tell are pairs whose spread is small beside what the
    shift leaves, constants among them.
    """
    facts = []
    for name in names:
        value = finite_number(df, name)
        facts += [F.avg(value), F.min(value), F.max(value)]
    found = aggregate_values(df, facts)
    shifted = []
    for i, name in enumerate(names):
        mean, low, high = found[3 * i : 3 * i + 3]
        shift = low if low == high else mean
        value = finite_number(df, name)
        shifted.append((value if shift is None else value - F.lit(shift)).alias(f"c{i}"))
    width = len(names)
    sums = df.select(*shifted).mapInPandas(lambda batches: pair_sums(batches, width), SUMS_SCHEMA)
    totals = sums.groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")]
    )

    def centred(square: str, left: str, right: str):
        return F.col(square) - F.try_divide(F.col(left) * F.col(right), F.col("n"))

    square_a = centred("sum_aa", "sum_a", "sum_a")
    square_b = centred("sum_bb", "sum_b", "sum_b")
    sound = (square_a > F.col("sum_aa") * LEAST_SPREAD) & (square_b > F.col("sum_bb") * LEAST_SPREAD)
    correlation = F.try_divide(centred("sum_ab", "sum_a", "sum_b"), F.sqrt(square_a * square_b))
    found = totals.select("a", "b", F.coalesce(sound, F.lit(False)).alias("sound"), correlation.alias("r")).collect()
    rows = [(names[x.a], names[x.b], x.r) for x in found if x.sound]
    again = [(names[x.a], names[x.b]) for x in found if not x.sound]
    return df.sparkSession.createDataFrame(rows, CORRELATION_SCHEMA), again
