"""Rank correlations with exact average ranks."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.profiling.columns import aggregate_values, numeric_columns, present
from plumbline.operators.profiling.packed_ranks import packable, put_ranks
from plumbline.operators.profiling.summary import correlations
from plumbline.session import stored

# A value is hot if it has more than this share of a column's rows, so there are fewer than this of them.
HOT_SHARE = 200
# Ranks of all values of a column are sent to every executor if there are at most so many.
BROADCAST_VALUES = 500_000


def average_ranks(df: DataFrame, name: str) -> DataFrame:
    """`value`, `n` and `rank` of every present value of a column; equal values share their average rank.

    Values are counted, dealt to tasks by range and sorted there; the totals of the ranges,
    one number each, say at which rank each begins. So no task sees more than its range,
    and a value held by many rows is one row.
    """
    counts = df.select(present(df, name).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("value").select("value", "n", F.spark_partition_id().alias("part"))
    # Written, since ranges are cut by a sample and must not be cut again.
    ranged = stored(ranged, "ranged-values")
    totals = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    begins = [0, *accumulate(n for _, n in totals)]
    past = df.sparkSession.createDataFrame([(part, begin) for (part, _), begin in zip(totals, begins, strict=False)], "part int, past bigint")
    before = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = ranged.withColumn("within", within).join(F.broadcast(past), "part")
    return placed.select("value", "n", (F.col("past") + F.col("within") + (F.col("n") + 1) / 2).alias("rank"))


def _with_ranks(rows: DataFrame, name: str, ranks: DataFrame, broadcast_values: int) -> DataFrame:
    """`rows` with the values of column `name` replaced by their ranks, NULL where missing."""
    ranks = ranks.select(F.col("value").alias("__value"), "n", F.col("rank").alias("__rank"))
    keyed = rows.withColumnRenamed(name, "__value")

    def put(met: DataFrame) -> DataFrame:
        return met.withColumnRenamed("__rank", name).select(*rows.columns)

    if ranks.count() <= broadcast_values:
        return put(keyed.join(F.broadcast(ranks.drop("n")), "__value", "left"))
    limit = ranks.agg(F.sum("n")).first()[0] // HOT_SHARE
    hot, cold = ranks.where(F.col("n") > limit).drop("n"), ranks.where(F.col("n") <= limit).drop("n")
    met = keyed.join(F.broadcast(hot), "__value", "left")
    found = met.where("__value IS NULL OR __rank IS NOT NULL")
    rest = met.where("__value IS NOT NULL AND __rank IS NULL").drop("__rank").join(cold, "__value")
    return put(found).unionByName(put(rest))


def rank_correlations(df: DataFrame, columns: list[str] | None = None, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Spearman correlation of every pair of numeric columns, in long form.

    Every value is ranked among the present values of its column, ties by their average
    rank, and the ranks of the rows where both values are present are correlated. NULL and
    NaN are missing; with a constant the correlation is NULL. Columns of at most about
    `broadcast_values` different values have their ranks sent to every executor. For the
    others blocks of rows ask ranges of the values for the ranks (see `packed_ranks`), so
    that all such columns take one shuffle of packed rows. Decimals of over 18 digits are
    joined to their ranks column by column, values held by many rows apart.
    """
    names = sorted(columns or numeric_columns(df))
    if len(names) < 2:
        return correlations(df, names)
    rows = df.select(*[present(df, name).alias(f"c{i}") for i, name in enumerate(names)])
    facts = [f for c in rows.columns for f in (F.count(c), F.approx_count_distinct(c, 0.02))]
    found = aggregate_values(rows, facts)
    counts, distinct = dict(zip(rows.columns, found[::2], strict=True)), dict(zip(rows.columns, found[1::2], strict=True))
    few = [c for c in rows.columns if distinct[c] <= broadcast_values]
    wide = [c for c in rows.columns if c not in few and not packable(rows.schema[c].dataType)]
    for c in few:
        # The number is an estimate, so there may be some more.
        rows = _with_ranks(rows, c, stored(average_ranks(df, names[int(c[1:])]), "value-ranks"), 2 * broadcast_values)
    for c in wide:
        # Written, since found and joined rows come from the same ones, twice as many scans with every column.
        rows = stored(_with_ranks(rows, c, stored(average_ranks(df, names[int(c[1:])]), "value-ranks"), broadcast_values), "joined-ranks")
    rest = {c: counts[c] for c in rows.columns if c not in few and c not in wide}
    ranked = stored((put_ranks(rows, rest) if rest else rows).toDF(*names), "ranks")
    return correlations(ranked, names)
