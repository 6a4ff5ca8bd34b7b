"""Looking features up by entity key and rounded time."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rowbytes import row_bytes

# A feature table up to this size is sent to every executor.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# A key holding more than 1/HOT_KEY_SHARE of the rows counts as hot, so there
# are at most HOT_KEY_SHARE hot keys.
HOT_KEY_SHARE = 200

STRATEGIES = ("auto", "broadcast", "shuffle", "split")


class FeatureFacts(NamedTuple):
    bytes: int
    most_rows_per_key: int


def feature_facts(features: DataFrame, keys: list[str]) -> FeatureFacts:
    """Modelled bytes and the largest number of rows that share one key.

    The inner count combines before its shuffle, and a feature table already
    grouped by the same keys needs no further shuffle.
    """
    width = row_bytes(features.schema, "wire")
    per_key = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b"))
    row = per_key.agg(F.sum("b"), F.max("n")).first()
    return FeatureFacts(row[0] or 0, row[1] or 0)


def _equal(left: DataFrame, right: DataFrame, keys: list[str], nulls: bool = False) -> Column:
    pairs = [(left[key], right[key]) for key in keys]
    return reduce(and_, [a.eqNullSafe(b) if nulls else a == b for a, b in pairs])


def _attach(df: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    renamed = features.withColumnsRenamed({key: f"__feature_{key}" for key in keys})
    matches = reduce(and_, [df[key] == renamed[f"__feature_{key}"] for key in keys])
    return df.join(renamed, matches, "left").drop(*[f"__feature_{key}" for key in keys])


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_KEY_SHARE) -> DataFrame:
    """Keys, NULL included, that hold more than 1/`share` of the rows: fewer than `share` rows.

    The bound on the result makes it safe to hold on the driver and to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") * share > F.lit(df.count())).select(*keys).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema)


def _split_join(df: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    hot = hot_keys(df, keys)
    is_hot = _equal(df, hot, keys, nulls=True)
    hot_features = features.join(F.broadcast(hot), _equal(features, hot, keys), "left_semi")
    hot_part = df.join(F.broadcast(hot), is_hot, "left_semi")
    cold_part = df.join(F.broadcast(hot), is_hot, "left_anti")
    return _attach(hot_part, F.broadcast(hot_features), keys).unionByName(
        _attach(cold_part, features, keys)
    )


def lookup_features(
    df: DataFrame,
    features: DataFrame,
    keys: list[str],
    strategy: str = "auto",
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Add the columns of `features` to every row of `df`; rows without a match get NULLs.

    `features` must hold one row per key, so the row count never changes; this is
    checked together with its size in one job over the feature side.

    `auto` broadcasts a feature table measured within `broadcast_limit`, so the
    large side is not moved at all. Beyond it both sides are shuffled on the keys:
    adaptive execution splits hot keys at run time (`shuffle`), or, where the
    session has that switched off, the hot keys are joined apart from the rest
    against their own few feature rows (`split`).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    clashes = set(df.columns) & set(features.columns) - set(keys)
    if clashes:
        raise ValueError(f"feature columns already present: {sorted(clashes)}")
    facts = feature_facts(features, keys)
    if facts.most_rows_per_key > 1:
        raise ValueError(f"features hold up to {facts.most_rows_per_key} rows for one key")
    fits = facts.bytes <= broadcast_limit
    if strategy == "broadcast" and not fits:
        raise ValueError(f"features need {facts.bytes} bytes, the limit is {broadcast_limit}")
    if strategy == "auto":
        strategy = "broadcast" if fits else _shuffle_strategy(df)
    if strategy == "broadcast":
        return _attach(df, F.broadcast(features), keys)
    if strategy == "split":
        return _split_join(df, features, keys)
    return _attach(df, features, keys)


def _shuffle_strategy(df: DataFrame) -> str:
    conf = df.sparkSession.conf
    adaptive = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    handled = all(conf.get(option) == "true" for option in adaptive)
    return "shuffle" if handled or df.isStreaming else "split"
