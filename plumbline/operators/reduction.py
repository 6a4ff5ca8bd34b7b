"""Cutting a dataset down to a byte budget, by sampling or by a row limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordering import from_sort_number, sort_number
from plumbline.operators.profiling.radix import order_statistics
from plumbline.operators.sizing import COLLECT_LIMIT_BYTES, dataset_size
from plumbline.operators.sketches import SAFE_MARGIN, quantile_of, quantile_sketches

METHODS = ("sample", "limit")

# Fixed value: what a NULL key is hashed as.
NULL_KEY = "NULL"

# A leading string is cut at a value that ranks a sample of this many rows; its rank is
# off by less than the margin.
SAMPLED_ROWS = 20_000
SAMPLE_MARGIN = 0.02
EDGE_CHARS = 64

# Up to this many candidate rows a plain top-k is cheap enough in one task.
NARROW_ABOVE_ROWS = 50_000_000


def sample_fraction(size: float, threshold_bytes: int) -> float:
    """Share of the rows that fits the threshold, at most 1."""
    return 1.0 if size <= threshold_bytes else threshold_bytes / size


def row_limit(rows: int, size: float, threshold_bytes: int) -> int:
    """Number of average rows that fits the threshold, at most all of them."""
    return rows if size <= threshold_bytes else int(rows * threshold_bytes / size)


def keyed_sample(df: DataFrame, key: Column | str, fraction: float) -> DataFrame:
    """Keep the rows whose hashed key falls below `fraction`.

    The choice depends on the key alone, not on file layout, partitioning or
    engine, so reruns and other engines keep the same rows. NULL is a key like others.
    """
    key = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    prefix = F.substring(F.md5(text.cast("binary")), 1, 8)
    return df.where(F.conv(prefix, 16, 10).cast("bigint") < F.lit(fraction * 4294967296.0))


def draw_number(key: Column, seed: int = 0) -> Column:
    """The first 60 bits of a key's md5 digest: a random whole number that only key and seed decide."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(NULL_KEY)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def exact_sample(df: DataFrame, k: int, key: Column | str, seed: int = 0) -> DataFrame:
    """Exactly `k` rows of `df`, or all if there are fewer, drawn by their keys.

    The rows with the `k` smallest random numbers are kept. The k-th number is found by
    radix selection, so nothing but counts is moved, and the same rows are drawn for any
    layout and by any engine. Of rows that share the last number, those of one key, the
    first in order of the columns that can be ordered are kept, so a key should name a
    row; equal rows can't be told apart and NULL is a key like others.
    """
    if k < 0:
        raise ValueError(f"cannot draw {k} rows")
    number = draw_number(F.col(key) if isinstance(key, str) else key, seed)
    drawn = df.select(number.alias("__drawn"))
    rows = drawn.count()
    if k >= rows:
        return df
    if k == 0:
        return df.limit(0)
    edge = order_statistics(drawn, {"__drawn": [k - 1]})["__drawn", k - 1]
    n_before, n_at = drawn.agg(F.count_if(F.col("__drawn") < edge), F.count_if(F.col("__drawn") == edge)).first()
    if n_before + n_at == k:
        return df.where(number <= edge)
    order = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.where(number < edge).unionAll(ordered_head(df.where(number == edge), k - n_before, order))


def ordered_head(
    df: DataFrame, k: int, order_by: list[str], narrow_above: int = NARROW_ABOVE_ROWS
) -> DataFrame:
    """The `k` smallest rows in ascending order of `order_by` (NULLs first).

    A plain top-k sends up to k rows per input partition to one task. While many
    candidates remain, a sketched quantile of the leading column cuts them down
    first; each cut is checked by exact counts, so the result is exact. A value
    shared by many rows at the cut is resolved on the remaining columns.
    """
    lead = order_by[0]
    known = _has_edges(df.schema[lead].dataType)
    candidates, rows = df, df.count() if known else 0
    while rows > max(narrow_above, 2 * k):
        edge = _edge(candidates, lead, k, rows)
        if edge is None:
            break
        before = F.col(lead).isNull() | (F.col(lead) < edge)
        at_edge = F.col(lead) == edge
        n_before, n_at = candidates.agg(F.count_if(before), F.count_if(at_edge)).first()
        if n_before < k <= n_before + n_at:
            ties, wanted, rest = candidates.where(at_edge), k - n_before, order_by[1:]
            tail = ordered_head(ties, wanted, rest, narrow_above) if rest else ties.limit(wanted)
            return candidates.where(before).unionByName(tail)
        if n_before < k or n_before == rows:
            break
        candidates, rows = candidates.where(before), n_before
    return candidates.orderBy(*order_by).limit(k)


def _has_edges(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType) or sort_number(F.lit(None).cast(dtype), dtype) is not None


def _edge(candidates: DataFrame, lead: str, k: int, rows: int) -> Column | None:
    """A value of the leading column that somewhat more than `k` of the rows lie before."""
    dtype = candidates.schema[lead].dataType
    if not isinstance(dtype, T.StringType):
        number = sort_number(F.col(lead), dtype)
        share = k / rows + SAFE_MARGIN
        cut = quantile_sketches(candidates, [number]).select(quantile_of("s0", [share])).first()[0]
        return None if cut is None else from_sort_number(cut[0], dtype)
    # The beginning of a string is as good a place to cut and bounds what is collected.
    few = candidates.sample(min(1.0, SAMPLED_ROWS / rows), seed=rows % 1000).select(F.substring(lead, 1, EDGE_CHARS))
    found = sorted((r[0] for r in few.collect() if r[0] is not None), key=str.encode)
    at = int((k / rows + SAMPLE_MARGIN) * len(found)) + 1
    return F.lit(found[at]) if at < len(found) else None


def unordered_head(df: DataFrame, k: int, rows: int, narrow_above: int = NARROW_ABOVE_ROWS) -> DataFrame:
    """Some `k` of the rows. Of many, a sample somewhat larger goes to the one task that counts them off.

    A plain limit has every input partition send up to `k` rows there.
    """
    share = 1.2 * k / max(rows, 1) + 1e-4
    while rows > narrow_above and share < 0.5:
        some = df.sample(share, seed=1)
        if some.count() >= k:
            return some.limit(k)
        share *= 2
    return df.limit(k)


def reduce_to_budget(
    df: DataFrame,
    method: str = "sample",
    size: float | None = None,
    threshold_bytes: int = COLLECT_LIMIT_BYTES,
    *,
    seed: int | None = None,
    key: Column | str | None = None,
    order_by: list[str] | None = None,
    exact: bool = False,
) -> DataFrame:
    """Reduce `df` to about `threshold_bytes`.

    `sample` keeps a random share of the rows, or with `key` a repeatable share
    of the keys, with `exact` as many rows as fit on average. `limit` keeps as many rows as fit on average, or with
    `order_by` the first of them in that order. A frame within the threshold
    comes back unchanged. `size` is measured when not given.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    if exact and (method != "sample" or key is None):
        raise ValueError("an exact sample needs the method 'sample' and a key")
    rows = None
    if size is None:
        rows, size = dataset_size(df)
    if size <= threshold_bytes:
        return df
    if method == "sample" and not exact:
        fraction = sample_fraction(size, threshold_bytes)
        return df.sample(fraction, seed=seed) if key is None else keyed_sample(df, key, fraction)
    rows = df.count() if rows is None else rows
    k = row_limit(rows, size, threshold_bytes)
    if exact:
        return exact_sample(df, k, key, seed or 0)
    return unordered_head(df, k, rows) if order_by is None else ordered_head(df, k, order_by)
