from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline import lookup_features, round_timestamps
from plumbline.operators.lookup import feature_facts, hot_keys
from tests.conftest import plan_of

KEYS = ["kind", "slot"]


@pytest.fixture
def events(spark, folder):
    raw = spark.read.parquet(f"{folder}/events.parquet")
    return round_timestamps(raw.withColumnRenamed("event_type", "kind"), {"ts": ("slot", 30)})


@pytest.fixture
def features(events):
    counted = events.where(F.col("kind") != "error").groupBy(*KEYS)
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle", "split"])
def test_strategies_agree(events, features, strategy):
    got = lookup_features(events, features, KEYS, strategy)
    want = events.join(features, KEYS, "left").select(*events.columns, "n", "mean")
    assert got.columns == want.columns
    assert got.count() == events.count()
    assert got.exceptAll(want).count() == 0
    assert got.where("n IS NULL").count() == events.where("kind = 'error'").count() > 0


def test_small_features_are_broadcast_and_large_ones_are_not(events, features):
    small = lookup_features(events, features, KEYS)
    assert "BroadcastHashJoin LeftOuter BuildRight" in plan_of(small)
    large = lookup_features(events, features, KEYS, broadcast_limit=10)
    events.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(large)
    finally:
        events.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="limit"):
        lookup_features(events, features, KEYS, "broadcast", broadcast_limit=10)


def test_without_adaptive_skew_handling_hot_keys_are_split_off(spark, setting, features, events):
    setting("spark.sql.adaptive.skewJoin.enabled", "false")
    got = lookup_features(events, features, KEYS, broadcast_limit=10)
    assert "Union" in plan_of(got)
    assert got.count() == events.count()


def test_a_key_with_a_third_of_the_rows_and_null_keys(spark):
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None)
        .otherwise(F.col("id")).alias("k"),
    )
    features = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") + 1).alias("f"))
    assert sorted(hot_keys(df, ["k"]).collect(), key=str) == [(0,), (None,)]
    got = lookup_features(df, features, ["k"], "split")
    assert got.count() == 6000
    assert got.where("k = 0 AND f = 1").count() == 2000
    assert got.where("k IS NULL AND f IS NULL").count() == 2000
    assert got.where("k > 0 AND k % 2 = 0 AND f = k + 1").count() == 1000
    assert got.where("k % 2 = 1 AND f IS NULL").count() == 1000


def test_hot_keys_are_fewer_than_the_share(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("k"))
    assert hot_keys(df, ["k"], share=5).count() == 4
    assert hot_keys(df, ["k"], share=4).count() == 0


def test_repeated_feature_keys_are_refused(events, features):
    with pytest.raises(ValueError, match="rows for one key"):
        lookup_features(events, features.unionByName(features), KEYS)


def test_clashing_columns_and_unknown_strategy(events, features):
    with pytest.raises(ValueError, match="already present"):
        lookup_features(events, features.withColumnRenamed("mean", "value"), KEYS)
    with pytest.raises(ValueError, match="strategy"):
        lookup_features(events, features, KEYS, "loop")


def test_facts_of_empty_features(features):
    assert feature_facts(features.where("false"), KEYS) == (0, 0)


def test_features_grouped_by_the_keys_are_checked_without_another_shuffle(features):
    width = features.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("c"))
    assert plan_of(width).count("Exchange\n") + plan_of(width).count("Arguments: hashpartitioning") <= 2


def test_lookup_on_a_stream(spark, folder, fresh, features):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    rounded = round_timestamps(stream.withColumnRenamed("event_type", "kind"), {"ts": ("slot", 30)})
    name = fresh("stream")
    query = (
        lookup_features(rounded, features, KEYS)
        .writeStream.format("memory")
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert spark.table(name).count() == spark.read.parquet(f"{folder}/events.parquet").count()
