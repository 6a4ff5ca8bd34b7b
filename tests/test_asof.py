from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import lookup_as_of
from tests.conftest import plan_of

DAY = dt.datetime(2024, 3, 1)


def at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def _brute_force(rows, features):
    out = []
    for i, k, t in rows:
        known = [(ft, a) for fk, ft, a in features if k is not None and fk == k and t is not None and ft is not None and ft <= t]
        best = max(known, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=(None, None))
        out.append((i, k, at(t), best[1], at(best[0])))
    return sorted(out, key=str)


def _frames(spark, rows, features, kind="timestamp_ntz"):
    df = spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], f"i int, k string, t {kind}")
    return df, spark.createDataFrame([(k, at(t), a) for k, t, a in features], f"k string, ft {kind}, a int")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    keys = ["hot"] * 6 + ["b", "c", None]
    rows = [(i, keys[rng.integers(9)], int(rng.integers(0, 5000)) if rng.random() < 0.97 else None) for i in range(1500)]
    features = [(keys[rng.integers(9)], int(rng.integers(0, 5000)), int(rng.integers(99))) for _ in range(300)]
    # Long without a feature, one instant with many rows, and several features at one time.
    rows += [(5000 + i, "hot", 9000) for i in range(200)] + [(6000, "only rows", 1), (6000, "only rows", 1)]
    features += [("hot", 8000, 1), ("hot", 8000, 7), ("hot", 8000, None), ("only features", 3, 3), ("b", None, 5)]
    return rows, features


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("part_rows", [1_000_000, 100, 7])
def test_agrees_with_brute_force(spark, data, part_rows, kind):
    df, features = _frames(spark, *data, kind)
    got = lookup_as_of(df, features, ["k"], "t", "ft", found_time="seen", part_rows=part_rows)
    assert got.columns == ["i", "k", "t", "a", "seen"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute_force(*data)


def test_hot_entities_are_cut(spark, data):
    from plumbline.operators import asof

    df, features = _frames(spark, *data)
    both = df.select("k", F.lit(1).alias("__side"), asof._number(F.col("t"), df.schema["t"].dataType).alias("__number")).dropna()
    hot = {r.k: r["__parts"] for r in asof._hot_entities(both, ["k"], 100).collect()}
    assert set(hot) == {"hot", "b", "c"} and hot["hot"] == sorted(hot["hot"]) and max(hot["hot"]) >= 8
    assert asof._hot_entities(both, ["k"], 10_000) is None


def test_other_times_and_several_keys(spark):
    left = spark.createDataFrame([(1, "x", 5, dt.date(2024, 1, 5)), (1, "y", 2, dt.date(2024, 1, 1)), (2, "x", 9, None)], "a int, b string, n int, d date")
    right = spark.createDataFrame([(1, "x", 4.5, 10), (1, "x", 5.0, 20), (1, "x", 6.0, 30), (1, "y", 3.0, 40)], "a int, b string, n double, v int")
    got = lookup_as_of(left, right.withColumn("n", F.col("n").cast("int")), ["a", "b"], "n")
    assert {(r.a, r.b, r.v) for r in got.collect()} == {(1, "x", 20), (1, "y", None), (2, "x", None)}
    dated = spark.createDataFrame([(1, dt.date(2024, 1, 4), "new"), (1, dt.date(2023, 1, 4), "old")], "a int, d date, s string")
    got = lookup_as_of(left, dated, ["a"], "d", part_rows=1)
    assert {(r.n, r.s) for r in got.collect()} == {(5, "new"), (2, "old"), (9, None)}


def test_empty_sides_and_clashing_names(spark, data):
    df, features = _frames(spark, *data)
    assert lookup_as_of(df.limit(0), features, ["k"], "t", "ft").count() == 0
    alone = lookup_as_of(df, features.limit(0), ["k"], "t", "ft")
    assert alone.count() == df.count() and alone.where("a IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="'i'"):
        lookup_as_of(df, features.withColumnRenamed("a", "i"), ["k"], "t", "ft")
    with pytest.raises(ValueError, match="'a'"):
        lookup_as_of(df, features, ["k"], "t", "ft", found_time="a")
    assert lookup_as_of(df, features.drop("a"), ["k"], "t", "ft", found_time="seen").where("seen IS NOT NULL").count() > 0


def test_one_pass_without_a_join_where_no_entity_is_hot(spark, data):
    df, features = _frames(spark, *data)
    plan = plan_of(lookup_as_of(df, features, ["k"], "t", "ft"))
    assert "Join" not in plan and plan.count("Window") >= 1
