from __future__ import annotations

import pandas as pd
import pyspark.pandas as ps
import pytest
from pyspark.sql import DataFrame

from plumbline import dataset_size, read_from_path, read_from_table, save_as_table, write_csv


@pytest.fixture
def orders(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet")


@pytest.fixture
def table(spark, orders, fresh):
    name = fresh("orders")
    save_as_table(spark, orders, name)
    return name


def readers(spark, table, folder):
    yield lambda **kw: read_from_table(spark, table, **kw)
    yield lambda **kw: read_from_path(spark, f"{folder}/orders.parquet", **kw)


def test_outcomes(spark, table, folder, orders):
    small = dataset_size(orders).bytes // 10
    for read in readers(spark, table, folder):
        assert isinstance(read(), DataFrame)
        assert isinstance(read(threshold_bytes=small, force_pandas=True), DataFrame)

        within = read(as_pandas=True)
        assert isinstance(within, pd.DataFrame) and len(within) == orders.count()

        over = read(as_pandas=True, threshold_bytes=small)
        assert isinstance(over, ps.DataFrame) and len(over) == orders.count()

        limited = read(as_pandas=True, threshold_bytes=small, force_pandas=True, force_method="limit")
        assert isinstance(limited, pd.DataFrame)
        assert len(limited) == int(orders.count() * small / dataset_size(orders).bytes)
        assert limited.memory_usage(deep=True, index=False).sum() <= small * 1.02

        sampled = read(as_pandas=True, threshold_bytes=small, force_pandas=True)
        assert isinstance(sampled, pd.DataFrame)
        assert len(sampled) == pytest.approx(orders.count() / 10, rel=0.5)


def test_limited_frames_keep_their_types(spark, folder):
    path = f"{folder}/orders.parquet"
    whole = read_from_path(spark, path, as_pandas=True)
    part = read_from_path(
        spark, path, as_pandas=True, threshold_bytes=9000, force_pandas=True, force_method="limit"
    )
    assert list(part.dtypes) == list(whole.dtypes)


def test_unknown_method_is_refused_before_any_work(spark, table, folder):
    for read in readers(spark, table, folder):
        with pytest.raises(ValueError, match="unknown method"):
            read(force_method="shrink")


def test_all_files_of_a_directory_are_read(spark, orders, tmp_path):
    path = str(tmp_path / "parts")
    write_csv(spark, orders.repartition(5), path)
    got = read_from_path(spark, path, as_pandas=True, schema=orders.schema)
    assert len(got) == orders.count()


def test_options_reach_the_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;2\n")
    got = read_from_path(spark, str(tmp_path), sep=";", inferSchema=True)
    assert got.dtypes == [("a", "int"), ("b", "int")]


def test_small_files_that_unpack_to_much_are_not_collected(spark, tmp_path):
    path = str(tmp_path / "packed")
    spark.range(50_000).selectExpr("repeat('x', 100) AS text").write.parquet(path)
    got = read_from_path(spark, path, as_pandas=True, threshold_bytes=1_000_000)
    assert isinstance(got, ps.DataFrame)


def test_an_empty_table_is_collected(spark, orders, fresh):
    name = fresh("none")
    save_as_table(spark, orders.where("false"), name)
    got = read_from_table(spark, name, as_pandas=True, threshold_bytes=0)
    assert isinstance(got, pd.DataFrame) and got.empty


def test_forcing_within_the_threshold_keeps_every_row(spark, orders, table):
    for method in ("sample", "limit"):
        got = read_from_table(spark, table, as_pandas=True, force_pandas=True, force_method=method)
        assert len(got) == orders.count()
