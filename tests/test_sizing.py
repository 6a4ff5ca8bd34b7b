from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import dataset_size, estimate_size, is_oversized, measure, reduce_to_budget
from plumbline.functions.rowbytes import row_width
from plumbline.operators.reduction import (
    exact_sample,
    keyed_sample,
    ordered_head,
    row_limit,
    sample_fraction,
    unordered_head,
)
from plumbline.session import ARROW
from tests.conftest import plan_of

ANY_FIXTURE = [HealthCheck.function_scoped_fixture]


def test_worked_example():
    # 100 rows, 1600 bytes, a threshold of 100 bytes.
    assert sample_fraction(1600, 100) == 0.0625
    assert row_limit(100, 1600, 100) == 6


def test_worked_example_on_a_frame(spark):
    df = spark.range(100).withColumn("b", F.col("id"))
    assert dataset_size(df) == (100, 1600)
    assert reduce_to_budget(df, "limit", threshold_bytes=100).count() == 6


def test_fraction_and_limit_never_exceed_the_whole():
    assert sample_fraction(10, 100) == 1.0
    assert sample_fraction(0, 100) == 1.0
    assert row_limit(7, 10, 100) == 7


def test_empty_frame(spark):
    df = spark.range(0).withColumn("s", F.lit("x"))
    assert dataset_size(df) == (0, 0)
    assert estimate_size(df) == 0
    assert not is_oversized(df, threshold_bytes=0)
    assert reduce_to_budget(df, "sample", threshold_bytes=1).count() == 0


def test_threshold_is_strict(spark):
    df = spark.range(10)
    assert not is_oversized(df, threshold_bytes=80)
    assert is_oversized(df, threshold_bytes=79)
    assert is_oversized(df, size=81, threshold_bytes=80)
    assert not is_oversized(df, size=80, threshold_bytes=80)


@pytest.mark.parametrize(
    ("name", "tolerance"),
    [("events", 0.001), ("orders", 0.001), ("lineitem", 0.001), ("part", 0.001),
     ("documents", 0.05)],
)
def test_model_against_pandas_memory(spark, folder, setting, name, tolerance):
    setting(ARROW, "true")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    real = df.toPandas().memory_usage(deep=True, index=False).sum()
    assert dataset_size(df).bytes == pytest.approx(real, rel=tolerance)


def test_model_counts_the_buffer_behind_array_values(spark, folder, setting):
    setting(ARROW, "true")
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    pdf = df.toPandas()
    # The arrays are views on one buffer, which pandas leaves out of its own count.
    real = pdf.memory_usage(deep=True, index=False).sum() + sum(a.nbytes for a in pdf.embedding)
    assert dataset_size(df).bytes == pytest.approx(real, rel=0.001)


def test_estimate_is_close(spark, folder):
    df = spark.read.parquet(f"{folder}/events.parquet")
    assert estimate_size(df, probe_rows=500, seed=3) == pytest.approx(dataset_size(df).bytes, rel=0.05)


def test_nested_and_null_values(spark):
    df = spark.sql(
        """
        SELECT array('a', 'bcd') AS strings, array(1, 2, 3) AS ints, map('k', 1L) AS m,
               named_struct('x', 1, 'y', 'zz') AS s, CAST(1 AS DECIMAL(10, 2)) AS d,
               CAST(NULL AS STRING) AS n, X'0102' AS b, true AS t
        """
    )
    wire = (8 + (8 + 1) + (8 + 3)) + (8 + 12) + (8 + (8 + 1) + 8 + 8) + (4 + 8 + 2) + 8 + 8 + 10 + 1
    assert dataset_size(df, "wire") == (1, wire)
    nothing = spark.createDataFrame([(None, None)], "a array<string>, s struct<x: int, y: string>")
    assert dataset_size(nothing, "wire") == (1, 8 + 4 + 8)


def test_unknown_layout(spark):
    with pytest.raises(ValueError, match="layout"):
        row_width(spark.range(1).schema, "paper")


def test_sizing_reads_only_variable_width_columns(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert "ReadSchema: struct<event_type:string,props:string>" in plan_of(measure(events))
    fixed = events.select("event_id", "ts", "user_id", "value")
    assert "ReadSchema: struct<>" in plan_of(measure(fixed))


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="unknown method"):
        reduce_to_budget(spark.range(3), "shrink")


def test_within_budget_is_unchanged(spark):
    df = spark.range(3)
    assert reduce_to_budget(df, "sample", threshold_bytes=24) is df
    assert reduce_to_budget(df, "limit", threshold_bytes=24) is df


@settings(max_examples=10, deadline=None, suppress_health_check=ANY_FIXTURE)
@given(threshold=st.integers(1, 20_000))
def test_limit_keeps_to_the_budget(spark, threshold):
    df = spark.range(1000)
    kept = reduce_to_budget(df, "limit", threshold_bytes=threshold).count()
    assert kept == min(1000, threshold // 8)


def test_sample_is_near_the_budget(spark):
    df = spark.range(100_000)
    for reduced in (
        reduce_to_budget(df, "sample", threshold_bytes=80_000, seed=5),
        reduce_to_budget(df, "sample", threshold_bytes=80_000, key="id"),
    ):
        assert reduced.count() == pytest.approx(10_000, rel=0.05)


def test_keyed_sample_ignores_the_layout(spark):
    df = spark.range(5000)
    kept = reduce_to_budget(df, "sample", threshold_bytes=8000, key="id")
    again = reduce_to_budget(df.repartition(7), "sample", threshold_bytes=8000, key="id")
    assert sorted(kept.collect()) == sorted(again.collect())


KEYS = {
    "bigint": lambda c: c,
    "double": lambda c: c / 7,
    "decimal": lambda c: (c / 10).cast("decimal(12, 1)"),
    "date": lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c.cast("int")),
    "timestamp": lambda c: F.timestamp_seconds(c * 1000),
    "timestamp_ntz": lambda c: F.timestamp_seconds(c * 1000).cast("timestamp_ntz"),
    "string": lambda c: F.lpad(c.cast("string"), 6, "0"),
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("k", [1, 40, 997])
def test_ordered_head_narrowed_equals_plain_sort(spark, kind, k):
    ids = spark.range(0, 20_000, 1, 8).select(F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("id"))
    df = ids.withColumn("key", KEYS[kind](F.col("id")))
    got = ordered_head(df, k, ["key", "id"], narrow_above=100)
    assert sorted(r.id for r in got.collect()) == list(range(k))


def test_ordered_head_with_a_third_of_the_rows_on_one_key(spark):
    df = spark.range(0, 9000, 1, 6).select(
        "id",
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 100 == 1, None)
        .otherwise(F.col("id") % 50).alias("hot"),
    )
    for k in (10, 150, 900, 2500, 5000):
        want = sorted(
            df.collect(), key=lambda r: (r.hot is not None, r.hot if r.hot is not None else 0, r.id)
        )[:k]
        got = ordered_head(df, k, ["hot", "id"], narrow_above=50).collect()
        assert sorted(r.id for r in got) == sorted(r.id for r in want), k
    assert ordered_head(df, 900, ["hot"], narrow_above=50).count() == 900


def test_ordered_head_of_nulls_only(spark):
    df = spark.range(500).select(F.lit(None).cast("int").alias("a"), "id")
    assert ordered_head(df, 20, ["a", "id"], narrow_above=10).agg(F.max("id")).first()[0] == 19


def test_unordered_head_of_many_rows_comes_from_a_sample(spark):
    df = spark.range(0, 50_000, 1, 10)
    for k in (1, 500, 20_000):
        got = unordered_head(df, k, 50_000, narrow_above=100)
        assert got.count() == k == got.distinct().count()
    assert unordered_head(df, 7, 50_000).count() == 7


def test_a_leading_string_is_cut_before_the_final_sort(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("s"), "id")
    got = ordered_head(df, 40, ["s", "id"], narrow_above=1000)
    assert "s#" in plan_of(got) and " < 00" in plan_of(got)
    assert sorted(r.id for r in got.collect()) == list(range(40))
    few = df.select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("s")).alias("s"), "id")
    want = sorted(few.collect(), key=lambda r: (r.s, r.id))
    for k in (50, 14_000):
        got = ordered_head(few, k, ["s", "id"], narrow_above=1000).collect()
        assert sorted(got) == sorted(want[:k])


def test_null_keys_are_sampled_like_other_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), "id")
    kept = [keyed_sample(df, "k", share).agg(F.count_if(F.col("k").isNull())).first()[0] for share in (0.05, 0.99)]
    assert kept == [0, 500]
    assert 450 < keyed_sample(df.where("k IS NOT NULL"), "k", 0.95).count() <= 500


def test_large_variants_are_measured_and_other_unknown_types_refused(spark):
    big = spark.sql("SELECT parse_json(concat('\"', repeat('x', 1000000), '\"')) AS v FROM range(3)")
    assert dataset_size(big).bytes >= 3_000_000
    assert is_oversized(big, threshold_bytes=2_000_000)
    assert dataset_size(spark.sql("SELECT CAST(NULL AS variant) AS v")).bytes > 0
    interval = spark.sql("SELECT make_interval(1, 2, 3) AS i")
    with pytest.raises(TypeError, match="no size is known"):
        dataset_size(interval)


@pytest.mark.parametrize("k", [0, 1, 500, 1999, 3000])
def test_exact_samples_have_exactly_k_rows_whatever_the_layout(spark, k):
    df = spark.range(2000).select("id", (F.col("id") * 2).alias("twice"))
    one = sorted(r.id for r in exact_sample(df.repartition(7), k, "id", seed=3).collect())
    two = sorted(r.id for r in exact_sample(df.orderBy(F.desc("id")).coalesce(1), k, "id", seed=3).collect())
    assert one == two and len(one) == min(k, 2000)
    if 0 < k < 1999:
        assert one != sorted(r.id for r in exact_sample(df, k, "id", seed=4).collect())


def test_exact_samples_are_even(spark):
    drawn = [r.id for r in exact_sample(spark.range(20_000), 5000, "id").collect()]
    assert all(1100 < sum(at <= i < at + 5000 for i in drawn) < 1400 for at in range(0, 20_000, 5000))


def test_exact_samples_of_repeated_keys(spark):
    df = spark.createDataFrame([(i % 3 or None, i, {"a": 1}) for i in range(90)], "k int, i int, m map<string,int>")
    for k in (5, 41, 89):
        got = exact_sample(df, k, "k").collect()
        assert len(got) == k == len({r.i for r in got})
    with pytest.raises(ValueError, match="cannot draw"):
        exact_sample(df, -1, "k")
    with pytest.raises(ValueError, match="needs"):
        reduce_to_budget(df, exact=True)
    some = reduce_to_budget(df, size=900, threshold_bytes=300, key="i", exact=True)
    assert some.count() == 30
