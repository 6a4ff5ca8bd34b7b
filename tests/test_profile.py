from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import profile
from plumbline.functions.digest import row_digest
from plumbline.operators.profiling.columns import facts_frame
from plumbline.operators.profiling import columns, dense, heavy, quantiles, radix, ranks, shapes, summary, values
from tests.conftest import plan_of

NAN = float("nan")


def rows(df):
    return {row[0]: row.asDict() for row in df.collect()}


@pytest.fixture
def odd(spark):
    """NULL, NaN, infinity, a constant column, nested and non-numeric columns."""
    return spark.createDataFrame(
        [
            (1, 1.0, 5, "a", dt.date(2024, 1, 1), [1]),
            (2, NAN, 5, "a", dt.date(2024, 1, 3), [2]),
            (3, None, 5, None, None, None),
            (4, 4.0, 5, "b", dt.date(2024, 1, 2), [2]),
        ],
        "id bigint, x double, c int, s string, d date, xs array<int>",
    )


def test_missing_counts_nan_and_null(odd):
    got = rows(summary.missing_values(odd))
    assert {k: v["n_missing"] for k, v in got.items()} == dict(id=0, x=2, c=0, s=1, d=1, xs=1)
    assert got["x"]["share_missing"] == 0.5


def test_numeric_statistics_skip_missing_values(odd):
    got = rows(summary.numeric_statistics(odd))
    assert set(got) == {"id", "x", "c"}
    assert (got["x"]["n"], got["x"]["mean"], got["x"]["min"], got["x"]["max"]) == (2, 2.5, 1.0, 4.0)
    assert got["c"]["stddev"] == 0 and got["c"]["skewness"] is None and got["c"]["kurtosis"] is None


def test_a_constant_over_several_tasks_has_no_spread(spark):
    df = spark.range(0, 6001, 1, 7).select(F.lit(0.1).alias("c"), F.col("id").alias("i"))
    row = summary.numeric_statistics(df, ["c"]).first()
    assert (row.stddev, row.skewness, row.kurtosis) == (0.0, None, None)
    assert summary.correlations(df).first().correlation is None


def test_correlation_of_a_constant_column_is_null(odd):
    got = {(r.column_a, r.column_b): r.correlation for r in summary.correlations(odd).collect()}
    assert got[("c", "id")] is None and got[("c", "x")] is None
    assert got[("id", "x")] == pytest.approx(1.0)


def test_correlations_of_many_columns_agree_with_the_built_in_way(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 9)) * 10.0 ** np.arange(-4, 5) + 1e6
    base[:, 3] += base[:, 1] * 50
    base[:, 7] = 0.1
    held = rng.random(base.shape) > 0.2
    data = [
        tuple(float(v) if ok else None for v, ok in zip(row, oks, strict=True))
        for row, oks in zip(base, held, strict=True)
    ]
    data[0] = (math.inf, NAN, *data[0][2:])
    df = spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(9))).repartition(5)
    def keyed(frame):
        return {(r.column_a, r.column_b): r.correlation for r in frame.collect()}

    got = keyed(summary.correlations(df))
    pairs = summary.correlation_facts(df, summary.column_pairs(df.columns))
    want = keyed(facts_frame(df, pairs, summary.CORRELATION_SCHEMA, 5))
    assert set(got) == set(want) and len(got) == 36
    for pair, value in want.items():
        if "c7" in pair:
            assert value is None and got[pair] is None
        else:
            x, y = (np.array([row[int(c[1])] for row in data], dtype=float) for c in pair)
            keep = np.isfinite(x) & np.isfinite(y)
            x, y = (v[keep].astype("longdouble") for v in (x, y))
            x, y = x - x.mean(), y - y.mean()
            exact = float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))
            assert got[pair] == pytest.approx(exact, abs=1e-9), pair
            # The built-in running means lose digits on small spreads around 1e6.
            assert value == pytest.approx(exact, abs=1e-5), pair


def test_wide_tables_take_several_passes(spark, folder, monkeypatch):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    sections = (
        summary.correlations,
        summary.numeric_statistics,
        summary.missing_values,
        shapes.histogram,
        values.distinct_counts,
        lambda d: values.value_counts(d, ["l_tax", "l_quantity", "l_discount"]),
        quantiles.exact_quantiles,
    )
    whole = [sorted(section(df).collect(), key=str) for section in sections]
    for module, name in (
        (summary, "PAIRS_PER_PASS"),
        (summary, "STATISTICS_PER_PASS"),
        (summary, "COLUMNS_PER_PASS"),
        (values, "COLUMNS_PER_PASS"),
        (values, "STRUCTS_PER_SCAN"),
        (columns, "AGGREGATES_PER_PASS"),
        (columns, "STRUCTS_PER_SCAN"),
    ):
        monkeypatch.setattr(module, name, 2)
    assert [sorted(section(df).collect(), key=str) for section in sections] == whole


def test_datetime_ranges(odd):
    row = summary.temporal_ranges(odd).first()
    assert (row["column"], row.n, row.span_seconds) == ("d", 3, 2 * 86400)
    assert row.min_ts == dt.datetime(2024, 1, 1)


def test_empty_and_columnless_inputs(spark, odd):
    none = odd.where("false")
    assert {r.n_missing for r in summary.missing_values(none).collect()} == {0}
    assert values.overview(none).first() == (0, 6, 0, 0)
    assert shapes.histogram(none).count() == 0 and shapes.pair_bins(none).count() == 0
    assert quantiles.exact_quantiles(none).count() == 0
    assert summary.approx_quantiles(none).count() == 0
    nested = odd.select("xs")
    assert values.top_values(nested).count() == values.distinct_counts(nested).count() == 0
    words = odd.select("s")
    for frame in (
        summary.numeric_statistics(words),
        summary.correlations(words),
        summary.approx_quantiles(words),
        quantiles.exact_quantiles(words),
        shapes.histogram(words),
        shapes.pair_bins(words),
        summary.temporal_ranges(words),
    ):
        assert frame.count() == 0


def test_overview_counts_duplicates(spark, odd):
    df = odd.unionByName(odd).unionByName(odd.limit(1))
    for by_values in (True, False):
        got = values.overview(df, by_values)
        assert got.columns == ["n_rows", "n_columns", "n_missing_cells", "n_duplicate_rows"]
        assert got.first() == (9, 6, 10, 5)


def test_duplicates_are_compared_by_value_unless_a_digest_is_asked_for(spark, folder):
    wide = spark.read.parquet(f"{folder}/documents.parquet")
    assert "hashpartitioning(digest_0#" in plan_of(values.overview(wide, by_values=False))
    assert "digest_0" not in plan_of(values.overview(wide))
    narrow = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_tax", "l_quantity")
    assert "hashpartitioning(l_tax#" in plan_of(values.overview(narrow))


def test_digest_tells_alike_rows_apart(spark):
    texts = spark.createDataFrame(
        [("a", None), (None, "a"), ("ab", "c"), ("a", "bc"), ("", None), (None, None), ("-", "")],
        "a string, b string",
    )
    assert texts.select(*row_digest(texts.schema)).distinct().count() == 7
    nested = spark.sql(
        """
        SELECT * FROM VALUES (array('a, b'), 1.5D, TIMESTAMP_NTZ'2024-01-01 00:00:00.000001'),
          (array('a', 'b'), 1.5D, TIMESTAMP_NTZ'2024-01-01 00:00:00.000001'),
          (array('a', 'b'), 1.5D, TIMESTAMP_NTZ'2024-01-01 00:00:00.000002'),
          (array('a', NULL), 1.5D, TIMESTAMP_NTZ'2024-01-01 00:00:00.000002') t(x, y, z)
        """
    ).withColumn("w", F.struct("x", "z"))
    assert nested.select(*row_digest(nested.schema)).distinct().count() == 4
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert zeros.select(*row_digest(zeros.schema)).distinct().count() == 1


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccd"], "v string")
    got = [(r["rank"], r.value, r.n) for r in values.top_values(df, 2).orderBy("rank").collect()]
    assert got == [(1, "a", 2), (2, "b", 2)]


def test_top_values_rank_inside_tasks_before_the_shuffle(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderpriority", "o_custkey")
    plan = plan_of(values.top_values(df, 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    assert "ReadSchema: struct<o_orderpriority:string>" in plan


def test_distinct_counts(odd):
    exact = {r["column"]: r.n_distinct for r in values.distinct_counts(odd, exact=True).collect()}
    assert exact == dict(id=4, x=2, c=1, s=2, d=3)
    sketched = {r["column"]: r.n_distinct for r in values.distinct_counts(odd).collect()}
    assert sketched == exact


def test_histogram_edges_and_missing_values(spark):
    data = [(float(v),) for v in range(11)] + [(NAN,), (None,), (math.inf,), (-math.inf,)]
    df = spark.createDataFrame(data, "x double")
    got = {r.bucket: (r.n, r.lower, r.upper) for r in shapes.histogram(df, 5).collect()}
    assert got == {1: (2, 0, 2), 2: (2, 2, 4), 3: (2, 4, 6), 4: (2, 6, 8), 5: (3, 8, 10)}


def test_constant_columns_fall_into_the_first_bucket(odd):
    got = {r["column"]: (r.bucket, r.n) for r in shapes.histogram(odd, 3, ["c"]).collect()}
    assert got == {"c": (1, 4)}
    with pytest.raises(ValueError):
        shapes.histogram(odd, 0)


def test_pair_bins_need_both_values(odd):
    got = shapes.pair_bins(odd, 2)
    totals = {(r[0], r[1]): r[2] for r in got.groupBy("column_a", "column_b").sum("n").collect()}
    assert totals == {("c", "id"): 4, ("c", "x"): 2, ("id", "x"): 2}


def test_pair_bins_in_several_passes(spark, folder, monkeypatch):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    whole = sorted(shapes.pair_bins(df, 4).collect()), sorted(shapes.histogram(df, 4).collect())
    monkeypatch.setattr(dense, "CELLS_PER_PASS", 60)
    assert (sorted(shapes.pair_bins(df, 4).collect()), sorted(shapes.histogram(df, 4).collect())) == whole


def test_pair_bins_hand_on_cells_and_not_rows(spark):
    df = spark.range(0, 50_000, 1, 4).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 3).alias("c"))
    counted = dense.cell_counts(df, [F.col(c) % 2 + 1 for c in "abc"], [(0, 1), (0, 2), (1, 2), (0, 1, 2)], 2)
    assert "Generate" not in plan_of(counted) and "Expand" not in plan_of(counted)
    assert {r["sum(n)"] for r in counted.groupBy("id").sum("n").collect()} == {50_000}
    assert counted.where("id = 3").count() <= 8


@pytest.mark.parametrize("listed_values", [10**6, 500, 3])
def test_exact_quantiles_with_any_number_of_passes(spark, listed_values):
    rng = np.random.default_rng(4)
    n = 6000
    columns = {
        "smooth": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n)),
        "outliers": np.where(rng.random(n) < 0.001, 1e300, rng.random(n) * 1e-9),
        "constant": np.full(n, 2.5),
    }
    data = list(zip(*(c.tolist() for c in columns.values()), strict=True))
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns)).repartition(5)
    points = (0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0)
    got = quantiles.exact_quantiles(df, points=points, listed_values=listed_values).collect()
    assert len(got) == len(columns) * len(points)
    for row in got:
        want = np.quantile(columns[row["column"]], row["quantile"])
        assert row.value == pytest.approx(want, rel=1e-12), row


@pytest.mark.parametrize("listed_values", [10**6, 2])
def test_typed_quantiles_keep_all_digits(spark, listed_values):
    rng = np.random.default_rng(8)
    whole = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 300)] + [-(1 << 63), (1 << 63) - 1, 0, -1, None]
    wide = [Decimal(int(a)) * (1 << 60) + int(b) for a, b in zip(whole[:-1], rng.integers(0, 1 << 40, 304), strict=True)]
    wide = [w.scaleb(-10) for w in wide] + [None]
    small = [int(x) for x in rng.integers(-128, 128, 305)]
    odd = [float("nan"), None, 0.0, -0.0, float("-inf"), 5e-324, -5e-324, 1.5, -1.5, float("inf")] * 30 + [2.0] * 5
    schema = "l bigint, d decimal(38,10), t tinyint, x double"
    df = spark.createDataFrame(list(zip(whole, wide, small, odd, strict=True)), schema).repartition(3)
    points = (0.0, 0.013, 0.5, 0.8, 1.0)
    got = {(r["column"], r["quantile"]): r for r in quantiles.typed_quantiles(df, points=points, listed_values=listed_values).collect()}
    for name, column in {"l": whole, "d": wide, "t": small, "x": odd}.items():
        held = sorted(v for v in column if v is not None and v == v)
        for p in points:
            at = p * (len(held) - 1)
            low, high, row = held[math.floor(at)], held[math.ceil(at)], got[name, p]
            if name == "x":
                assert (row.lower, row.upper) == (None, None)
                assert row.value == (low if low == high else pytest.approx(low * (1 - row.share_upper) + high * row.share_upper))
            else:
                digits = (lambda v: f"{v:.10f}") if name == "d" else str
                assert (row.lower, row.upper) == (digits(low), digits(high))
                assert row.value == pytest.approx(float(low) + (float(high) - float(low)) * row.share_upper, rel=1e-12)


def test_order_statistics_move_counts_only(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    counted = radix._counted(df, ["l_quantity"], [radix.Count(0, 0, 0, 16)])
    plan = plan_of(counted)
    assert "ReadSchema: struct<l_quantity:double>" in plan and plan.count("Exchange") >= 1
    assert counted.agg(F.sum("n")).first()[0] == df.count()
    assert counted.count() <= 50


def test_approx_quantiles_are_near(spark):
    df = spark.range(0, 200_000, 1, 9).select(F.col("id").cast("int").alias("x"))
    for row in summary.approx_quantiles(df).collect():
        assert row.value == pytest.approx(row["quantile"] * 200_000, abs=600)


def test_profile_sections(odd):
    got = profile(odd, bins=4, top_k=2)
    assert sorted(got) == sorted(
        ["overview", "missing", "numeric", "datetime", "distinct", "quantiles", "correlations",
         "top_values", "histogram", "pair_bins", "text", "boolean"]
    )
    for section, alone in {
        "missing": summary.missing_values(odd),
        "numeric": summary.numeric_statistics(odd),
        "datetime": summary.temporal_ranges(odd),
        "distinct": values.distinct_counts(odd),
        "correlations": summary.correlations(odd),
        "histogram": shapes.histogram(odd, 4),
        "pair_bins": shapes.pair_bins(odd, 4),
        "top_values": values.top_values(odd, 2),
        "overview": values.overview(odd),
    }.items():
        assert got[section].schema.names == alone.schema.names, section
        assert sorted(got[section].collect(), key=str) == sorted(alone.collect(), key=str), section


def test_profile_of_words_only(odd):
    got = profile(odd.select("s"))
    assert got["numeric"].count() == 0 and got["histogram"].count() == 0
    assert got["missing"].first().n_missing == 1


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "`a.b` int, `c``d` double")
    got = profile(df)
    assert got["overview"].first().n_duplicate_rows == 1
    assert {r["column"] for r in got["numeric"].collect()} == {"a.b", "c`d"}
    for frame in got.values():
        frame.count()


def test_negative_zero_and_the_order_of_map_entries_make_no_difference(spark):
    floats = spark.createDataFrame([([0.0],), ([-0.0],), ([1.0],)], "x array<double>")
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    plain = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    for df in (floats, maps, plain):
        for by_values in (True, False):
            assert values.overview(df, by_values).first().n_duplicate_rows == 1


def test_duplicates_over_chosen_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "b", 1)], "id int, t string, n int")
    for by_values in (True, False):
        got = values.overview(df, by_values, ["t"]).first()
        assert (got.n_rows, got.n_columns, got.n_missing_cells, got.n_duplicate_rows) == (3, 3, 1, 1)


def test_a_correlation_does_not_depend_on_the_number_of_columns(spark):
    """Values missing on one side leave a spread far below the shift of the whole column."""
    data = [(1e9 + i % 5, float(i % 5) + 0.1 * (i % 3), i % 2 * 1e9 + i) for i in range(300)]
    data += [(0.0, None, float(i)) for i in range(300)]
    df = spark.createDataFrame(data, "a double, b double, z double")
    wide = df.select("*", *[F.rand(i).alias(f"c{i}") for i in range(5)])
    found = []
    for frame in (df.select("a", "b"), df, wide):
        rows = {(r.column_a, r.column_b): r.correlation for r in summary.correlations(frame).collect()}
        found.append(rows["a", "b"])
    x, y = (np.array([float(row[i] - (1e9 if i == 0 else 0)) for row in data[:300]]) for i in (0, 1))
    assert all(r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7) for r in found)
    assert max(found) - min(found) < 1e-12


def test_spans_are_between_instants(spark, setting):
    setting("spark.sql.session.timeZone", "America/New_York")
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t UNION ALL SELECT timestamp'2024-07-01 00:00:00'")
    assert summary.temporal_ranges(df).first().span_seconds == 15_721_200
    ntz = df.select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert summary.temporal_ranges(ntz).first().span_seconds == 15_724_800


def test_distinct_counts_have_a_row_for_every_column(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    for exact in (True, False):
        assert {tuple(r) for r in values.distinct_counts(df, exact=exact).collect()} == {("a", 1), ("b", 0)}


@pytest.mark.parametrize("wanted", [0.3, 0.5999, 0.6001, 0.9])
def test_exact_quantiles_beside_a_value_that_holds_most_rows(spark, wanted):
    df = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 10 < 6, 0.0).otherwise(F.col("id") / 7 + 1).alias("x")
    )
    got = quantiles.exact_quantiles(df, points=(wanted,), listed_values=2_000)
    assert got.first().value == pytest.approx(np.quantile([r.x for r in df.collect()], wanted), rel=1e-12)


@pytest.mark.parametrize("broadcast_bytes", [values.BROADCAST_BYTES, 0])
def test_duplicates_are_compared_by_value_where_digests_agree(spark, monkeypatch, broadcast_bytes):
    # A digest that takes only four values: almost all rows are suspects.
    short = lambda schema: [(F.pmod(d, F.lit(4))).alias(f"digest_{i}") for i, d in enumerate(row_digest(schema))]
    rows = [(i % 40 or None, f"t{i % 3}", float("nan") if i % 5 else -0.0, [i % 2]) for i in range(300)] + [(None, None, 0.0, None)] * 200
    df = spark.createDataFrame(rows, "a int, b string, c double, d array<int>").repartition(3)
    want = values.overview(df, by_values=False).first()
    assert values.overview(df, broadcast_bytes=broadcast_bytes, grouped_rows=0).first() == want
    assert want.n_duplicate_rows == 500 - df.distinct().count() > 199
    monkeypatch.setattr(values, "row_digest", short)
    assert values.overview(df, broadcast_bytes=broadcast_bytes, grouped_rows=0).first() == want
    assert values.overview(df.limit(0), broadcast_bytes=broadcast_bytes, grouped_rows=0).first() == (0, 4, 0, 0)


def test_only_suspects_are_shuffled_whole(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("text"))
    df = df.unionByName(df.where("id < 7"))
    assert values._suspects(df, df.columns, df.schema, values.BROADCAST_BYTES).count() == 14
    assert values.overview(df, grouped_rows=0).first().n_duplicate_rows == 7 == values.overview(df).first().n_duplicate_rows


def test_values_are_counted_as_bits_where_they_lie_close(spark):
    lows = spark.range(0, 4000, 1, 2).select(
        (F.col("id") % 700 - 350).cast("int").alias("near"), F.xxhash64("id").alias("far"),
        F.lit(None).cast("bigint").alias("none"), (F.lit((1 << 63) - 1) - F.col("id") % 9).alias("top"),
        (F.col("id") * 30 - 60_000).alias("stretches"),
    )
    assert set(values._whole_ranges(lows, lows.columns)) == {"near", "top", "stretches"}
    got = {r["column"]: r.n_distinct for r in values.distinct_counts(lows, exact=True, grouped_rows=0).collect()}
    assert got == {"near": 700, "far": lows.select("far").distinct().count(), "none": 0, "top": 9, "stretches": 4000}


def _skewed(spark):
    """Zipf texts, an all-unique key, unique doubles, few values, none, and odd types."""
    return spark.range(0, 30_000, 1, 5).select(
        F.concat(F.lit("w"), F.floor(F.pow(F.rand(3), -1.5))).alias("zipf"),
        (F.col("id") * 7 % 30_000 + 100).alias("key"),
        (F.col("id") / 3).alias("x"),
        F.nullif(F.col("id") % 4, F.lit(2)).cast("tinyint").alias("few"),
        F.lit(None).cast("string").alias("none"),
        F.timestamp_seconds(F.col("id") % 7).alias("ts"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("zero"),
    ).cache()


def test_top_values_are_those_of_full_counts(spark, monkeypatch):
    df = _skewed(spark)
    monkeypatch.setattr(heavy, "HELD_AT_LEAST", 60)
    monkeypatch.setattr(heavy, "HELD_PER_WANTED", 2)
    monkeypatch.setattr(heavy, "WAITING", 500)
    got = {}
    for r in values.top_values(df, 4, grouped_rows=0).orderBy("column", "rank").collect():
        got.setdefault(r["column"], []).append((r.value, r.n))
    want = {}
    for r in values.value_counts(df).collect():
        want.setdefault(r["column"], []).append((r.value, r.n))
    assert got == {name: sorted(found, key=lambda x: (-x[1], x[0]))[:4] for name, found in want.items()}
    found = heavy.frequent_values(df, ["zipf", "x", "few", "none", "ts"], 4)
    assert {name for name, _, _ in found.rows} == {"zipf", "few"} and sorted(found.unproved) == ["ts", "x"]
    assert values._unique_columns(df, ["key", "few"]) == ["key"]


def test_a_unique_key_shuffles_few_rows_a_task(spark):
    plan = plan_of(heavy.smallest_texts(_skewed(spark), ["key"], 3))
    assert plan.index("WindowGroupLimit") > 0 and "Partial" in plan


def test_summaries_count_too_low_by_their_error_at_most(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(heavy, "WAITING", 100)
    rng = np.random.default_rng(1)
    summary, all_ = heavy.Summary(40), []
    for _ in range(60):
        some = [f"v{int(x)}" for x in rng.zipf(1.3, 50) % 10_000]
        all_ += some
        summary.add(pa.array([*some, None]))
    summary.cut()
    held = dict(zip(summary.values.to_pylist(), summary.counts.tolist(), strict=True))
    assert len(held) <= 40 and summary.error > 0
    for value in set(all_):
        assert all_.count(value) - summary.error <= held.get(value, 0) <= all_.count(value)
    monkeypatch.setattr(heavy, "SUMMARY_BYTES", 5000)
    long = heavy.Summary(40)
    for i in range(200):
        long.add(pa.array([f"{i}" * 400, "often"]))
    long.cut()
    assert long.values.nbytes <= 5000 and dict(zip(long.values.to_pylist(), long.counts.tolist(), strict=True)).get("often", 0) >= 200 - long.error


@pytest.mark.parametrize("broadcast_values", [10**6, 0])
def test_rank_correlations_agree_with_pandas(spark, broadcast_values):
    import pandas as pd

    rng = np.random.default_rng(12)
    n = 3000
    x = rng.normal(size=n)
    frame = pd.DataFrame(
        {"x": x, "cubed": x**3, "hot": np.where(rng.random(n) < 0.5, 0.0, rng.integers(-20, 20, n)), "flat": 1.0,
         "signed": np.where(x < 0, -0.0, np.abs(np.round(x)))}
    )
    df = spark.createDataFrame([tuple(map(float, r)) for r in frame.itertuples(index=False)], ", ".join(f"{c} double" for c in frame))
    got = {(r.column_a, r.column_b): r.correlation for r in ranks.rank_correlations(df.repartition(6), broadcast_values=broadcast_values).collect()}
    want = frame.corr("spearman")
    assert len(got) == 10
    for (a, b), r in got.items():
        assert r is None if "flat" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_rows_are_not_scanned_again_for_every_ranked_column(spark, monkeypatch):
    plans = {}
    keep = ranks.stored

    def stored(df, label):
        plans[label] = plan_of(df)
        return keep(df, label)

    monkeypatch.setattr(ranks, "stored", stored)
    df = spark.range(2000).select(*[((F.col("id") * 7919 + i) % (900 + i)).alias(f"v{i}") for i in range(5)])
    assert ranks.rank_correlations(df, broadcast_values=0).count() == 10
    # Each scan is named in the tree and below it.
    assert plans["ranks"].count("Scan parquet") <= 4


@pytest.mark.parametrize("broadcast_values", [100, 0])
def test_ranks_of_every_type_from_many_blocks_and_ranges(spark, monkeypatch, broadcast_values):
    from decimal import Decimal

    from plumbline.operators.profiling import packed_ranks

    rng = np.random.default_rng(4)
    n = 2500
    price = rng.integers(-5000, 5000, n)
    x = np.where(rng.random(n) < 0.2, -0.0, rng.normal(size=n))
    x[:2] = [np.inf, -np.inf]
    columns = {
        "near": (9007199254740993 + rng.integers(0, 900, n)).tolist(), "small": rng.integers(-3, 3, n).tolist(),
        "price": [Decimal(int(v)).scaleb(-2) for v in price], "wide": [Decimal(int(v)).scaleb(-2) for v in price * 7],
        "zeros": np.where(x > 1, 0.0, x).tolist(), "x": x.tolist(),
    }
    for name in ("near", "price", "zeros"):
        columns[name] = [None if gap else v for gap, v in zip(rng.random(n) < 0.1, columns[name], strict=True)]
    types = ["bigint", "int", "decimal(18,2)", "decimal(38,2)", "double", "double"]
    rows = [*zip(*columns.values(), strict=True), (None, None, None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True)))
    monkeypatch.setattr(packed_ranks, "RANGE_ROWS", 300)
    given = packed_ranks.put_ranks
    cuts = []

    def put_ranks(rows, counts):
        cuts.append(counts)
        return given(rows, counts)

    monkeypatch.setattr(ranks, "put_ranks", put_ranks)
    got = {(r.column_a, r.column_b): r.correlation for r in ranks.rank_correlations(df.repartition(7), broadcast_values=broadcast_values).collect()}
    assert max(cuts[0].values()) > 4 * packed_ranks.RANGE_ROWS

    def placed(values):
        held = sorted(v for v in values if v is not None)
        first, last = {}, {}
        for i, v in enumerate(held, start=1):
            first.setdefault(v, i)
            last[v] = i
        return [np.nan if v is None else (first[v] + last[v]) / 2 for v in values]

    want = {name: np.array(placed(values)) for name, values in columns.items()}
    assert len(got) == 15
    for (a, b), r in got.items():
        both = ~np.isnan(want[a]) & ~np.isnan(want[b])
        assert r == pytest.approx(np.corrcoef(want[a][both], want[b][both])[0, 1], abs=1e-9)


def test_bits_are_set_without_a_sort_of_all_rows(spark, monkeypatch):
    import pyarrow as pa

    df = spark.range(0, 200_000, 1, 3).select((F.col("id") % 70_000 * 2 - 9).alias("v"), F.when(F.col("id") % 3 > 0, F.lit(4).cast("int")).alias("w"))
    counted = values._bit_counts(df, ["v", "w"], {"v": -9, "w": 4})
    before_shuffle = plan_of(counted, "simple").rsplit("Exchange", 1)[1]
    assert "MapInArrow" in before_shuffle and "bitmap_construct_agg" not in before_shuffle
    got = {r["column"]: r.n for r in counted.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    assert got == {"v": 70_000, "w": 1}
    held = [pa.RecordBatch.from_pydict({"v": np.arange(at, at + 50_000)}) for at in (0, 20_000, 0)]
    monkeypatch.setattr(values, "ROWS_PER_FILL", 50_000)
    monkeypatch.setattr(values, "HELD_BITMAPS", 1)
    bits = {}
    for out in values._bitmaps(iter(held)):
        for r in out.to_pylist():
            bits[r["stretch"]] = bits.get(r["stretch"], 0) | int.from_bytes(r["bits"], "big")
    assert sum(b.bit_count() for b in bits.values()) == 70_000


def test_numbers_are_made_text_only_where_listed(spark):
    rows = [(i % 7, float(i % 5) / 4, None) for i in range(700)] + [(-(2**62) - 1, -0.0, 1)] * 300 + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "a bigint, b double, c tinyint").repartition(3)
    got = heavy.frequent_values(df, ["a", "b", "c"], 2)
    assert got.unproved == [] and sorted(got.rows) == [("a", "-4611686018427387905", 300), ("a", "0", 100), ("b", "0.0", 440), ("b", "0.25", 140), ("c", "1", 300)]
    assert heavy._countable(df, "a")[0] == "whole" and heavy._countable(df, "b")[0] == "real"


def test_average_ranks_run_over_all_ranges(spark, setting):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(0, 5000, 1, 3).select(F.floor(F.sqrt("id")).alias("v")).unionAll(spark.range(7).select(F.lit(None).cast("bigint")))
    found = ranks.average_ranks(df, "v")
    got = {r.value: r["rank"] for r in found.collect()}
    held = sorted(r.v for r in df.dropna().collect())
    assert got == {v: held.index(v) + (held.count(v) + 1) / 2 for v in set(held)}
    assert "SinglePartition" not in plan_of(found)


def test_odd_columns_have_rank_correlations_or_none(spark, odd):
    assert ranks.rank_correlations(odd.select("s")).count() == 0
    assert ranks.rank_correlations(odd.where("false")).where("correlation IS NOT NULL").count() == 0


def test_text_and_boolean_columns(spark):
    df = spark.createDataFrame([("a", True), ("", None), (None, False), ("éé🙂", None)], "t string, b boolean")
    assert tuple(summary.text_statistics(df).first()) == ("t", 3, 1, 0, pytest.approx(4 / 3), 3)
    assert tuple(summary.boolean_statistics(df).first()) == ("b", 1, 1, 2)
    assert summary.text_statistics(df.where("false")).first().n == 0
    assert summary.boolean_statistics(df.select("t")).count() == 0


def test_pairs_of_values_keep_every_value(spark):
    df = spark.createDataFrame([("a", True, 1), ("b", None, 2), (None, False, 3), ("a", True, 9)], "t string, b boolean, n int")
    got = {tuple(r) for r in shapes.value_pairs(df, ["t", "b", "n"], bins=2).collect()}
    assert got == {("b", "n", "true", "1", 1), ("b", "n", "true", "2", 1), ("b", "n", "false", "1", 1),
                   ("b", "t", "true", "a", 2), ("n", "t", "1", "a", 1), ("n", "t", "2", "a", 1), ("n", "t", "1", "b", 1)}
    assert shapes.value_pairs(df, ["t"]).count() == 0
