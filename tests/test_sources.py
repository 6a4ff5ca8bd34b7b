from __future__ import annotations

from pathlib import Path

import pytest

from plumbline import file_inventory, infer_format, read_files, read_from_path, total_bytes
from plumbline.sources.files import FormatUnavailable
from tests.conftest import plan_of


def put(folder: Path, **files: str) -> str:
    for name, content in files.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(folder)


@pytest.mark.parametrize(
    ("files", "expected"),
    [
        ({"x_dot_csv": "a\n1\n", "y_dot_csv": "a\n2\n"}, "csv"),
        ({"x_dot_csv": "a\n1\n", "readme_dot_txt": "hi"}, "csv"),
        ({"x_dot_csv": "a\n1\n", "_SUCCESS": "", "e_dot_csv": ""}, "csv"),
        ({"x_dot_CSV": "a\n1\n"}, "csv"),
        ({"k=1__x_dot_parquet": "data", "k=2__y_dot_parquet": "data"}, "parquet"),
        ({"a_dot_txt": "hello"}, "text"),
        ({"_delta_log__0_dot_json": "{}", "k=1__part_dot_parquet": "data"}, "delta"),
        ({"_delta_log__0_dot_json": "{}"}, "delta"),
        ({"_delta_log__0_dot_json": "{}", "x_dot_csv": "a", "y_dot_parquet": "b"}, "delta"),
    ],
)
def test_format_of_a_directory(spark, tmp_path, files, expected):
    assert infer_format(spark, put(tmp_path, **files)) == expected


def test_format_of_a_single_file(spark, tmp_path):
    assert infer_format(spark, put(tmp_path, x_dot_csv="a\n1\n") + "/x.csv") == "csv"


@pytest.mark.parametrize(
    ("files", "message"),
    [
        ({"x_dot_csv": "a", "y_dot_parquet": "b"}, "several formats"),
        ({"x_dot_csv": "a", "y_dot_parquet": "b", "z_dot_txt": "c"}, "several formats"),
        ({}, "no data files"),
        ({"e_dot_csv": ""}, "no data files"),
        ({"plain": "a"}, "no extension"),
    ],
)
def test_directories_without_one_format(spark, tmp_path, files, message):
    with pytest.raises(ValueError, match=message):
        infer_format(spark, put(tmp_path, **files))


def test_inventory_lists_nonempty_visible_files_without_opening_them(spark, tmp_path):
    path = put(tmp_path, a_dot_csv="12345", sub__b_dot_csv="123", _hidden="1", empty_dot_csv="")
    files = file_inventory(spark, path)
    assert sorted((Path(r.path).name, r.length) for r in files.collect()) == [
        ("a.csv", 5),
        ("b.csv", 3),
    ]
    assert "content" not in plan_of(files)
    assert total_bytes(spark, path) == 8


def test_total_bytes_of_nothing(spark, tmp_path):
    assert total_bytes(spark, str(tmp_path)) == 0


def test_csv_defaults_and_overrides(spark, tmp_path):
    path = put(tmp_path, x_dot_csv='a,b\n1,"say ""hi"""\n')
    assert read_files(spark, path, "csv").collect() == [("1", 'say "hi"')]
    assert read_files(spark, path, "csv", header=False).count() == 2
    assert read_files(spark, path, "csv", inferSchema=True).dtypes[0] == ("a", "int")
    assert read_files(spark, path, "csv", schema="a bigint, b string").dtypes[0] == ("a", "bigint")


def test_tsv_reads_tabs(spark, tmp_path):
    path = put(tmp_path, x_dot_tsv="a\tb\n1\t2,3\n")
    assert read_files(spark, path, "tsv").collect() == [("1", "2,3")]


def test_missing_connectors_are_named(spark, tmp_path):
    path = put(tmp_path, _delta_log__0_dot_json="{}")
    for filetype in ("delta", "nosuchformat"):
        with pytest.raises(FormatUnavailable, match=filetype):
            read_files(spark, path, filetype)


def _values(spark, path, **options):
    """All rows read from a path, the same as Spark and as pandas."""
    rows = sorted(map(tuple, read_from_path(spark, path, **options).collect()))
    frame = read_from_path(spark, path, as_pandas=True, **options)
    assert sorted(map(tuple, frame.itertuples(index=False))) == rows
    return rows


def test_files_in_plain_folders_are_all_read(spark, tmp_path):
    path = put(
        tmp_path, top_dot_csv="a\n1\n2\n", a__x_dot_csv="a\n3\n", b__c__y_dot_CSV="a\n4\n5\n", b___z_dot_csv="a\n9\n"
    )
    assert _values(spark, path, schema="a int") == [(1,), (2,), (3,), (4,), (5,)]
    assert _values(spark, f"{path}/b", schema="a int") == [(4,), (5,)]


def test_partition_folders_stay_columns(spark, tmp_path):
    spark.range(6).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(str(tmp_path / "t"))
    assert _values(spark, str(tmp_path / "t")) == [(i, i % 2) for i in range(6)]


def test_text_beside_data_is_not_read(spark, tmp_path):
    path = put(tmp_path, x_dot_csv="a\n1\n2\n", readme_dot_txt="hello\nworld\n", sub__more_dot_txt="this\n")
    assert _values(spark, path, schema="a int") == [(1,), (2,)]
    spark.range(3).write.mode("append").parquet(str(tmp_path / "p"))
    put(tmp_path / "p", readme_dot_txt="hi")
    assert _values(spark, str(tmp_path / "p")) == [(0,), (1,), (2,)]
    only = put(tmp_path / "t", a_dot_txt="one\n", b__c_dot_txt="two\n")
    assert _values(spark, only) == [("one",), ("two",)]


def test_a_single_file_is_read_alone(spark, tmp_path):
    path = put(tmp_path, x_dot_csv="a\n1\n", y_dot_csv="a\n2\n")
    assert _values(spark, f"{path}/x.csv", schema="a int") == [(1,)]


@pytest.mark.parametrize(
    ("files", "expected"),
    [
        ({"x_dot_csv_dot_gz": "a", "y_dot_CSV_dot_BZ2": "a", "z_dot_csv": "a"}, "csv"),
        ({"x_dot_json_dot_zst": "a", "notes_dot_txt_dot_gz": "a"}, "json"),
        ({"x_dot_gz": "a"}, "gz"),
    ],
)
def test_a_compression_is_no_format(spark, tmp_path, files, expected):
    assert infer_format(spark, put(tmp_path, **files)) == expected


def test_compressed_files_are_read(spark, tmp_path):
    import gzip

    put(tmp_path, a_dot_csv="x\n1\n", readme_dot_txt="x\n9\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"x\n2\n"))
    (tmp_path / "c.CSV.gz").write_bytes(gzip.compress(b"x\n3\n"))
    got = read_from_path(spark, str(tmp_path))
    assert sorted(r.x for r in got.collect()) == ["1", "2", "3"]


@pytest.mark.parametrize(
    ("files", "expected"),
    [
        ({"k=1__a_dot_csv": "x\n1\n", "x__b_dot_csv": "x\n2\n"}, {("1", 1), ("2", None)}),
        ({"x__k=1__a_dot_csv": "x\n1\n", "x__k=2__b_dot_csv": "x\n2\n"}, {("1", 1), ("2", 2)}),
        ({"b_dot_csv": "x\n2\n", "k=1__a_dot_csv": "x\n1\n", "y__k=3__c_dot_csv": "x\n3\n", "y__z__c_dot_csv": "x\n4\n"},
         {("1", 1), ("2", None), ("3", 3), ("4", None)}),
        ({"k=1__a_dot_csv": "x\n1\n", "k=2__b_dot_csv": "x\n2\n"}, {("1", 1), ("2", 2)}),
    ],
)
def test_partitions_stay_columns_wherever_they_are(spark, tmp_path, files, expected):
    got = read_from_path(spark, put(tmp_path / "run=5" / "in here", **files))
    assert {(r.x, r.k) for r in got.collect()} == expected


def test_plain_folders_inside_partitions_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="inside partitions"):
        read_from_path(spark, put(tmp_path, **{"k=1__y__a_dot_csv": "x\n1\n"}))
