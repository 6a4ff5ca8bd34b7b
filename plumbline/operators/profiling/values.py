"""Profile sections that group by value: duplicates, distinct counts, top values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.digest import row_digest
from plumbline.functions.names import quoted
from plumbline.operators.profiling.columns import (
    STRUCTS_PER_SCAN,
    chunked,
    facts_frame,
    flat_columns,
    present,
    union_all,
)
from plumbline.operators.profiling.heavy import frequent_values, smallest_texts
from plumbline.operators.profiling.radix import column_ranges
from plumbline.operators.profiling.summary import (
    COLUMNS_PER_PASS,
    DISTINCT_SCHEMA,
    distinct_facts,
)
from plumbline.session import settle


# Tables of at most so many rows are grouped by value at once: further passes over them would cost more.
GROUPED_ROWS = 20_000_000
# Digests met twice, 16 bytes each, are sent to every executor up to this size.
BROADCAST_BYTES = 32 << 20
# Parts that the rows of one digest are joined in, where the digests are too many for that.
SALTS = 16
# Bits of a bitmap as `bitmap_or_agg` takes it.
BITMAP_BITS = 4096 * 8
# Rows that a task sorts before it sets their bits, the bitmaps it holds and those it hands on at once.
ROWS_PER_FILL, HELD_BITMAPS, BITMAPS_PER_BATCH = 1 << 20, 1 << 16, 1 << 10
# Bits of a task's bitmaps for each of its rows, at most, for counting values as bits.
BITS_PER_ROW = 128


def overview(
    df: DataFrame,
    by_values: bool = True,
    duplicate_columns: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    grouped_rows: int = GROUPED_ROWS,
) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows (rows beyond the first of their kind).

    Rows are duplicates if all their values are equal, or those of `duplicate_columns`.
    Beyond `grouped_rows` they are found in two phases: digests of 8 bytes tell which were met twice, and only
    rows with one of those are moved whole and compared by value; the digests met twice
    are kept in the checkpoint folder, if there is one. With `by_values=False` rows are
    compared by a 16-byte digest instead, which is wrong only in a 128-bit collision.
    Copies are counted before each shuffle, so a row repeated very often costs one entry
    per task.
    """
    missing = sum((present(df, c).isNull().cast("bigint") for c in df.columns), F.lit(0))
    compared = duplicate_columns or df.columns
    schema = df.select(*[quoted(c) for c in compared]).schema
    if by_values:
        rows = df.select(*[quoted(c) for c in compared]) if _is_small(df, grouped_rows) else _suspects(df, compared, schema, broadcast_bytes)
        copies = rows.groupBy(*[quoted(c) for c in compared])
        beyond = copies.agg(F.count(F.lit(1)).alias("__n")).agg(F.sum(F.col("__n") - 1).alias("n_duplicate_rows"))
        totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(missing).alias("n_missing_cells"))
        both = totals.unionByName(beyond, allowMissingColumns=True)
        found = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_missing_cells", "n_duplicate_rows")])
    else:
        keyed = df.select(*row_digest(schema), missing.alias("__missing"))
        per_row = keyed.groupBy("digest_0", "digest_1").agg(
            F.count(F.lit(1)).alias("__n"), F.sum("__missing").alias("__missing")
        )
        rows = F.coalesce(F.sum("__n"), F.lit(0))
        found = per_row.agg(
            rows.alias("n_rows"),
            F.coalesce(F.sum("__missing"), F.lit(0)).alias("n_missing_cells"),
            (rows - F.count(F.lit(1))).alias("n_duplicate_rows"),
        )
    return found.select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_missing_cells", "n_duplicate_rows")


def _is_small(df: DataFrame, grouped_rows: int) -> bool:
    return grouped_rows > 0 and df.count() <= grouped_rows


def _suspects(df: DataFrame, compared: list[str], schema: T.StructType, broadcast_bytes: int) -> DataFrame:
    """The rows, with the columns compared, whose digest another row has too."""
    rows = df.select(*[quoted(c) for c in compared])
    if " collate " in schema.simpleString():
        # Strings that are equal under a collation can have different digests.
        return rows
    digest = row_digest(schema)[0].alias("__digest")
    twice = rows.select(digest).groupBy("__digest").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__digest")
    twice = settle(twice)
    keyed = rows.select("*", digest)
    if twice.count() * 16 <= broadcast_bytes:
        return keyed.join(F.broadcast(twice), "__digest", "left_semi").drop("__digest")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt")
    copied = twice.select("__digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
    return keyed.select("*", salt).join(copied, ["__digest", "__salt"], "left_semi").drop("__digest", "__salt")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per (column, value), missing values left out and values shown as text.

    Columns of one type share a scan and a shuffle and are grouped in that type;
    only the distinct values are turned into text. Partial counts are formed
    before the shuffle, so a value held by most rows is no hot spot.
    """
    by_type: dict[str, list[str]] = {}
    names = columns or flat_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    for name in names:
        by_type.setdefault(df.schema[name].dataType.simpleString(), []).append(name)
    counted = []
    for alike in by_type.values():
        for chunk in chunked(alike, STRUCTS_PER_SCAN):
            typed = df.select(*[present(df, name).alias(name) for name in chunk])
            long = typed.unpivot([], [quoted(name) for name in chunk], "column", "value")
            grouped = long.where(F.col("value").isNotNull()).groupBy("column", "value")
            counts = grouped.agg(F.count(F.lit(1)).alias("n"))
            counted.append(counts.withColumn("value", F.col("value").cast("string")))
    return union_all(counted)


def top_values(
    df: DataFrame, k: int = 10, columns: list[str] | None = None, grouped_rows: int = GROUPED_ROWS
) -> DataFrame:
    """The `k` most frequent values per column, ties broken by value.

    Up to `grouped_rows` all columns are grouped by value. Beyond that whole numbers that lie close together are first counted as bits: where as many values
    as rows are found, all occur once, and each task hands on its `k` smallest. Other
    columns are summarised in each task, and an exact count of few candidates proves the
    answer. Only columns where that fails are grouped by value, with the rank filter
    applied inside each task before the ranking shuffle.
    """
    names = columns or flat_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, rank bigint")
    if _is_small(df, grouped_rows):
        parts = [value_counts(df, names)]
    else:
        unique = _unique_columns(df, names)
        found = frequent_values(df, [name for name in names if name not in unique], k)
        parts = [df.sparkSession.createDataFrame(found.rows, "column string, value string, n bigint")]
        if unique:
            parts.append(smallest_texts(df, unique, k))
        if found.unproved:
            parts.append(value_counts(df, found.unproved))
    ranking = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    ranked = union_all(parts).withColumn("rank", F.row_number().over(ranking))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def _unique_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Whole-number columns whose present values are all different, as far as bitmaps can tell."""
    ranges = _whole_ranges(df, names)
    close = {name: low for name, (n, low, high) in ranges.items() if high - low + 1 >= n}
    counts = {}
    for chunk in chunked(list(close), STRUCTS_PER_SCAN):
        found = _bit_counts(df, chunk, close).groupBy("column").agg(F.sum("n").alias("n"))
        counts |= {r["column"]: r.n for r in found.collect()}
    return [name for name, n in counts.items() if n == ranges[name][0]]


def distinct_counts(
    df: DataFrame, columns: list[str] | None = None, exact: bool = False, grouped_rows: int = GROUPED_ROWS
) -> DataFrame:
    """Distinct present values per column: sketched in one pass, or exact.

    Exact counts beyond `grouped_rows` rows come from bitmaps, in which a value is a bit, for
    whole numbers that lie close together; others are grouped by value.
    """
    names = columns or flat_columns(df)
    if not exact:
        return facts_frame(df, distinct_facts(df, names), DISTINCT_SCHEMA, COLUMNS_PER_PASS)
    close = {} if _is_small(df, grouped_rows) else {name: low for name, (_, low, _) in _whole_ranges(df, names).items()}
    parts = [_bit_counts(df, chunk, close) for chunk in chunked(list(close), STRUCTS_PER_SCAN)]
    rest = [name for name in names if name not in close]
    if rest:
        parts.append(value_counts(df, rest).select("column", F.lit(1).cast("bigint").alias("n")))
    # Columns without any value have a row too.
    parts.append(df.sparkSession.createDataFrame([(name, 0) for name in names], "column string, n bigint"))
    return union_all(parts).groupBy("column").agg(F.sum("n").alias("n_distinct"))


def _whole_ranges(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int, int]]:
    """Values, smallest and largest one of whole-number columns whose bitmaps take a task few bits for each of its rows."""
    whole = [name for name in names if isinstance(df.schema[name].dataType, T.IntegralType)]
    if not whole:
        return {}
    tasks = max(1, df.select(*[quoted(name) for name in whole]).rdd.getNumPartitions())
    ranges = column_ranges(df, whole)
    return {name: (n, low, high) for name, (n, low, high) in ranges.items() if n and high - low < BITS_PER_ROW * n // tasks}


def _bit_counts(df: DataFrame, names: list[str], low: dict[str, int]) -> DataFrame:
    """Values per bitmap of each column: a task fills a bitmap of 32,768 bits for every stretch it meets."""
    offsets = [(quoted(name).cast("bigint") - F.lit(low[name]).cast("bigint")).alias(name) for name in names]
    bitmaps = df.select(*offsets).mapInArrow(_bitmaps, "place int, stretch bigint, bits binary")
    column = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("place") + 1).alias("column")
    whole = bitmaps.groupBy("place", "stretch").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.select(column, F.bitmap_count("bits").alias("n"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the stretches of all columns that a task meets, a stretch more than once where they outgrow HELD_BITMAPS."""
    held: dict[tuple[int, int], np.ndarray] = {}
    waiting: list[pa.RecordBatch] = []

    def fill() -> None:
        for i, column in enumerate(pa.Table.from_batches(waiting).columns if waiting else ()):
            values = np.unique(column.combine_chunks().drop_null().to_numpy(zero_copy_only=False))
            stretch = values // BITMAP_BITS
            ends = np.append(np.flatnonzero(np.diff(stretch)) + 1, len(values))
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if b > a:
                    flags = np.zeros(BITMAP_BITS, np.uint8)
                    flags[values[a:b] % BITMAP_BITS] = 1
                    bits, key = np.packbits(flags), (i, int(stretch[a]))
                    held[key] = held[key] | bits if key in held else bits
        waiting.clear()

    def handed_on() -> Iterator[pa.RecordBatch]:
        for keys in chunked(list(held), BITMAPS_PER_BATCH):
            places, stretches = zip(*keys, strict=True)
            bits = [held.pop(key).tobytes() for key in keys]
            yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int32()), "stretch": pa.array(stretches, pa.int64()), "bits": pa.array(bits, pa.binary())})

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= ROWS_PER_FILL:
            fill()
            if len(held) > HELD_BITMAPS:
                yield from handed_on()
    fill()
    yield from handed_on()
