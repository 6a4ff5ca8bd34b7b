from __future__ import annotations

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline import (
    create_schema,
    example_table,
    export,
    file_inventory,
    provision,
    read_files,
    save_as_table,
    split_table_name,
    write_csv,
)
from plumbline.sinks.tables import partition_columns
from tests.conftest import plan_of


@pytest.fixture
def customer(spark, folder):
    return spark.read.parquet(f"{folder}/customer.parquet")


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("t", ("spark_catalog", "default", "t")),
        ("s.t", ("spark_catalog", "s", "t")),
        ("c.s.t", ("c", "s", "t")),
    ],
)
def test_names_are_completed(name, parts):
    assert split_table_name(name) == parts


@pytest.mark.parametrize("name", ["a.b.c.d", "", ".t", "s.", "a..b", "`a.b`.c", " "])
def test_bad_names(name):
    with pytest.raises(ValueError, match="invalid table name"):
        split_table_name(name)


def test_append_is_the_default(spark, customer, fresh):
    name = fresh()
    save_as_table(spark, customer, name)
    save_as_table(spark, customer, name)
    assert spark.table(name).count() == 2 * customer.count()


def test_modes(spark, customer, fresh):
    name = fresh()
    save_as_table(spark, customer, name)
    save_as_table(spark, customer, name, mode="overwrite")
    assert spark.table(name).count() == customer.count()
    save_as_table(spark, customer, name, mode="ignore")
    with pytest.raises(AnalysisException):
        save_as_table(spark, customer, name, mode="errorifexists")


def test_properties_are_applied_and_left_alone(spark, customer, fresh, tmp_path):
    name, folder = fresh(), str(tmp_path / "data")
    properties = {"partitionBy": "c_mktsegment", "path": folder, "compression": "gzip"}
    before = dict(properties)
    save_as_table(spark, customer, name, table_properties=properties)
    assert properties == before
    assert partition_columns(spark, name) == ["c_mktsegment"]
    paths = [row.path for row in file_inventory(spark, folder).collect()]
    assert paths and all("c_mktsegment=" in p and ".gz.parquet" in p for p in paths)


def test_an_append_keeps_the_layout_of_the_table(spark, customer, fresh):
    name = fresh()
    save_as_table(spark, customer, name, table_properties={"partitionBy": ["c_mktsegment", "c_nationkey"]})
    save_as_table(spark, customer, name)
    assert partition_columns(spark, name) == ["c_mktsegment", "c_nationkey"]
    assert spark.table(name).count() == 2 * customer.count()


def test_partitioned_writes_are_rebalanced_and_reads_are_pruned(spark, customer, fresh):
    name = fresh()
    save_as_table(spark, customer, name, table_properties={"partitionBy": "c_mktsegment"})
    one = spark.table(name).where("c_mktsegment = 'BUILDING'")
    assert "PartitionFilters: [isnotnull(c_mktsegment" in plan_of(one)
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_of(customer.hint("rebalance", "c_mktsegment"))


def test_pandas_and_pandas_on_spark_inputs(spark, fresh):
    name = fresh()
    pdf = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    save_as_table(spark, pdf, name)
    save_as_table(spark, spark.createDataFrame(pdf).pandas_api(), name)
    assert spark.table(name).count() == 4
    assert spark.table(name).where("b IS NULL").count() == 2


def test_requirements_create_the_schema(spark, customer, fresh):
    schema = fresh("schema")
    with pytest.raises(AnalysisException):
        save_as_table(spark, customer, f"{schema}.t")
    save_as_table(spark, customer, f"spark_catalog.{schema}.t", create_requirements=True)
    assert spark.table(f"{schema}.t").count() == customer.count()
    create_schema(spark, schema)


def test_csv_keeps_texts_whole(spark, tmp_path):
    rows = [(1, ' a "quoted", text \n with\r\nlines '), (2, ""), (3, None), (4, "é\\n\\")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    write_csv(spark, df, str(tmp_path / "csv"))
    back = read_files(
        spark,
        str(tmp_path / "csv"),
        "csv",
        schema=df.schema,
        multiLine=True,
    )
    assert sorted(map(tuple, back.collect())) == rows


def test_csv_from_pandas_has_a_header_and_no_index(spark, tmp_path):
    write_csv(spark, pd.DataFrame({"a": [7], "b": ["x"]}), str(tmp_path / "csv"))
    (file,) = [p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv"]
    assert file.read_text() == "a,b\n7,x\n"


def test_small_exports_are_one_file(spark, folder, tmp_path):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet").repartition(6)
    assert export(lineitem, str(tmp_path / "one")) == 1
    assert file_inventory(spark, str(tmp_path / "one")).count() == 1


def test_large_exports_are_split_without_a_shuffle(spark, folder, tmp_path):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    files = export(lineitem, str(tmp_path / "many"), target_file_bytes=100_000)
    assert files > 3
    assert file_inventory(spark, str(tmp_path / "many")).count() >= files
    assert spark.read.parquet(str(tmp_path / "many")).exceptAll(lineitem).count() == 0
    export(lineitem, str(tmp_path / "even"), target_file_bytes=100_000, rebalance=True)
    assert spark.read.parquet(str(tmp_path / "even")).count() == lineitem.count()


def test_an_empty_export(spark, tmp_path):
    assert export(spark.range(0), str(tmp_path / "none")) == 1
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_bad_export_target(spark, tmp_path):
    with pytest.raises(ValueError):
        export(spark.range(1), str(tmp_path / "x"), target_file_bytes=0)


@pytest.mark.parametrize("reliable", [True, False])
def test_provisioning_can_run_twice(spark, folder, fresh, monkeypatch, reliable):
    if not reliable:
        monkeypatch.setattr("plumbline.plans.provision.shared_folder", lambda spark: None)
    events = spark.read.parquet(f"{folder}/events.parquet")
    trips = example_table(events, {"ts": ("slot", 15)}, fraction=0.2)
    schema = fresh("case")
    places = ["prd", "stg", "dev"]
    for mode in ("errorifexists", "overwrite"):
        names = provision(spark, trips, places, schema, "inputs", mode=mode)
    with pytest.raises(AnalysisException, match="already exists"):
        provision(spark, trips, places, schema, "inputs")
    assert names == [f"spark_catalog.{e}_{schema}.inputs" for e in ("prd", "stg", "dev")]
    first, *others = [sorted(spark.table(name).collect()) for name in names]
    assert first and all(other == first for other in others)


def test_provisioning_whole_catalogs(spark, customer, fresh):
    schema = fresh("case")
    names = provision(spark, customer, ["spark_catalog"], schema, "inputs", catalogs=True)
    assert names == [f"spark_catalog.{schema}.inputs"]
    assert spark.table(names[0]).count() == customer.count()


def test_example_table_is_repeatable(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    one, two = (example_table(events, {"ts": ("slot", 15)}, fraction=0.1) for _ in range(2))
    assert sorted(one.collect()) == sorted(two.collect())
    assert 0 < one.count() < events.count()
    assert one.agg(F.count_if(F.second("slot") != 0)).first()[0] == 0


def test_only_partitions_with_rows_are_overwritten(spark, fresh):
    name = fresh()
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4)], "i int, p string, q int")
    with pytest.raises(ValueError, match="name the partition columns"):
        save_as_table(spark, first, name, mode="overwrite_partitions")
    save_as_table(spark, first, name, mode="overwrite_partitions", table_properties={"partitionBy": "p"})
    second = spark.createDataFrame([("a", 9, 10), ("c", 8, 11), (None, 7, 12)], "p string, q int, i int")
    for _ in range(2):
        save_as_table(spark, second, name, mode="overwrite_partitions")
        assert {(r.i, r.p, r.q) for r in spark.table(name).collect()} == {(10, "a", 9), (11, "c", 8), (12, None, 7), (3, "b", 3)}
    save_as_table(spark, second.limit(0), name, mode="overwrite_partitions")
    assert spark.table(name).count() == 4
    with pytest.raises(ValueError, match="partitioned by"):
        save_as_table(spark, second, name, mode="overwrite_partitions", table_properties={"partitionBy": "q"})
    with pytest.raises(ValueError, match="has columns"):
        save_as_table(spark, second.drop("i"), name, mode="overwrite_partitions")


def test_a_failed_overwrite_of_partitions_leaves_the_table_as_it_was(spark, fresh):
    name = fresh()
    rows = spark.range(100).select("id", (F.col("id") % 4).alias("p"))
    save_as_table(spark, rows, name, table_properties={"partitionBy": "p"})
    broken = rows.repartition(4).withColumn("id", F.when(F.col("id") == 97, F.raise_error("no")).otherwise(F.col("id") + 1000).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        save_as_table(spark, broken, name, mode="overwrite_partitions")
    assert sorted(r.id for r in spark.table(name).collect()) == list(range(100))
