"""Every operator as a named query over the given tables.

Each callable takes (spark, folder of parquet tables) and returns a DataFrame. No
query filters, samples or caps its input unless that is the operator itself.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.timegrid import (
    ceil_to_grid,
    ceil_to_grid_seconds,
    seconds_to_timestamp,
    wall_clock_seconds,
)
from plumbline.operators.asof import lookup_as_of
from plumbline.operators.lookup import lookup_features
from plumbline.operators.profiling import quantiles, ranks, shapes, summary, values
from plumbline.operators.profiling.columns import facts_frame, present_number, union_all
from plumbline.operators.reduction import exact_sample, ordered_head, reduce_to_budget, sample_fraction
from plumbline.operators.sizing import dataset_size, estimate_size, is_oversized, measure
from plumbline.operators.timestamps import round_timestamps
from plumbline.plans.provision import EXAMPLE_FRACTION, example_table, provision
from plumbline.plans.report import profile
from plumbline.plans.routing import read_from_path, read_from_table
from plumbline.session import scratch_path, settle
from plumbline.sinks.files import export, write_csv
from plumbline.sinks.tables import as_spark, save_as_table
from plumbline.sources.files import read_files
from plumbline.sources.inventory import file_inventory, format_census, survey_path

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL in `oracle`.
BUDGET_BYTES = 100_000
OVERSIZE_BYTES = 2_000_000
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
ENVIRONMENTS = ("prd", "stg", "dev")
ALIKE = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
ALIKE_TEXTS = ("text", "lang", "source", "n_chars")
HEAD_ROWS = 700

EVENT_GRIDS = {"ts": [("rounded_15", 15), ("rounded_30", 30)]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def _saved(
    spark: SparkSession, df: DataFrame, times: int = 1, partition_by: str | None = None
) -> DataFrame:
    """Save `df` to a fresh table, append it again `times - 1` times, and read the table."""
    name = _name("saved")
    properties = {"path": scratch_path(spark, name)}
    if partition_by is not None:
        properties["partitionBy"] = partition_by
    save_as_table(spark, df, name, table_properties=properties)
    for _ in range(times - 1):
        save_as_table(spark, df, name)
    return spark.read.table(name)


def _file_copy(spark: SparkSession, df: DataFrame, fmt: str, **options: object) -> DataFrame:
    """Write `df` in another format and read it back through the dispatcher."""
    path = scratch_path(spark, fmt)
    if fmt in ("csv", "tsv"):
        write_csv(spark, df, path, **({"sep": "\t"} if fmt == "tsv" else {}))
    else:
        df.write.format({"txt": "text"}.get(fmt, fmt)).save(path)
    schema = None if fmt in ("orc", "parquet") else df.schema
    return read_files(spark, path, fmt, schema, **options)


# --- timestamps, columns, lookup ---------------------------------------------------


def ts_ceil(minutes: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        events = table(spark, folder, "events")
        return events.select("event_id", ceil_to_grid("ts", minutes).alias("rounded"))

    return query


def ts_ceil_seconds(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("event_id", ceil_to_grid_seconds("ts", 15).alias("rounded_seconds"))


def round_two_grids(spark: SparkSession, folder: str) -> DataFrame:
    return round_timestamps(table(spark, folder, "events"), EVENT_GRIDS)


def epoch_to_ts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    back = seconds_to_timestamp(wall_clock_seconds("ts"), with_zone=False)
    return events.select("event_id", back.alias("ts_seconds"))


def drop_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").drop("o_orderdate", "o_orderpriority")


def temp_view(spark: SparkSession, folder: str) -> DataFrame:
    view = _name("rounded_orders")
    round_timestamps(table(spark, folder, "orders"), {"o_orderdate": ("order_slot", 30)}, view)
    return spark.sql(
        f"SELECT o_orderstatus, order_slot, count(*) AS n FROM {view} "
        "GROUP BY o_orderstatus, order_slot"
    )


def feature_lookup(spark: SparkSession, folder: str, strategy: str = "auto") -> DataFrame:
    """The flagship: events on two grids, with the activity counts of both slots attached."""
    events = round_timestamps(table(spark, folder, "events"), EVENT_GRIDS)
    per_15 = events.groupBy("event_type", "rounded_15").agg(
        F.count(F.lit(1)).alias("events_15"), F.max("value").alias("max_value_15")
    )
    per_30 = events.groupBy("event_type", "rounded_30").agg(F.count(F.lit(1)).alias("events_30"))
    with_15 = lookup_features(events, settle(per_15), ["event_type", "rounded_15"], strategy)
    return lookup_features(with_15, settle(per_30), ["event_type", "rounded_30"], strategy).select(
        "event_id", "event_type", "rounded_15", "rounded_30",
        "events_15", "max_value_15", "events_30",
    )


def feature_lookup_missing(spark: SparkSession, folder: str) -> DataFrame:
    """A left lookup with NULL keys and keys without features, on the split strategy."""
    events = round_timestamps(table(spark, folder, "events"), EVENT_GRIDS).withColumn(
        "event_type", F.nullif("event_type", F.lit("error"))
    )
    purchases = events.where(F.col("event_type").isin("purchase", "view"))
    features = purchases.groupBy("event_type", "rounded_30").agg(
        F.count(F.lit(1)).alias("events_30")
    )
    keys = ["event_type", "rounded_30"]
    return lookup_features(events, settle(features), keys, "split").select(
        "event_id", "event_type", "rounded_30", "events_30"
    )


def feature_lookup_hot(spark: SparkSession, folder: str, strategy: str = "split") -> DataFrame:
    """A lookup by the event type alone: each of the few keys, NULL too, holds many rows."""
    events = table(spark, folder, "events").withColumn(
        "event_type", F.nullif("event_type", F.lit("error"))
    )
    known = events.where("event_type <> 'click'")
    features = known.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_of_type"))
    found = lookup_features(events, settle(features), ["event_type"], strategy)
    return found.select("event_id", "event_type", "n_of_type")


# --- sizing and reduction ----------------------------------------------------------


def _dear_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of large value as features of their type and user, as they became known."""
    events = table(spark, folder, "events").where("value > 300")
    return events.groupBy("event_type", "ts").agg(F.max("value").alias("dear_value"), F.max("event_id").alias("dear_event"))


def feature_lookup_as_of(spark: SparkSession, folder: str, part_rows: int = 2_000_000) -> DataFrame:
    """Every event with the latest one of large value and its type at or before it."""
    events = table(spark, folder, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "ts")
    features = _dear_events(spark, folder)
    return lookup_as_of(events, features, ["event_type"], "ts", found_time="dear_ts", part_rows=part_rows)


def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").agg(F.count(F.lit(1)).alias("n_rows"))


def size_exact(spark: SparkSession, folder: str) -> DataFrame:
    sized = [
        measure(table(spark, folder, name), layout).select(
            F.lit(name).alias("table_name"), F.lit(layout).alias("layout"), "n_rows", "n_bytes"
        )
        for name in ("events", "documents", "embeddings")
        for layout in ("pandas", "wire")
    ]
    return union_all(sized)


def size_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Exact bytes of the documents, and whether the estimate is within 5% of them."""
    documents = table(spark, folder, "documents")
    estimate, exact = estimate_size(documents, seed=1), dataset_size(documents).bytes
    near = abs(estimate - exact) <= 0.05 * exact
    return spark.createDataFrame(
        [("documents", exact, near)], "table_name string, n_bytes bigint, near boolean"
    )


def oversized(spark: SparkSession, folder: str) -> DataFrame:
    answers = [
        (name, is_oversized(table(spark, folder, name), threshold_bytes=OVERSIZE_BYTES))
        for name in ("events", "documents", "lineitem", "customer")
    ]
    return spark.createDataFrame(answers, "table_name string, oversized boolean")


def reduce_sample_by_key(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return reduce_to_budget(events, "sample", threshold_bytes=BUDGET_BYTES, key="event_id")


def reduce_sample_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly 777 events, drawn by their ids."""
    return exact_sample(table(spark, folder, "events"), 777, "event_id", seed=5).select("event_id", "user_id", "value")


def reduce_sample_exact_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly 500 orders drawn by customer: of the last one the first rows in order of the columns."""
    orders = table(spark, folder, "orders").select(F.nullif("o_custkey", F.lit(7)).alias("customer"), "o_orderkey")
    return exact_sample(orders, 500, "customer")


def reduce_limit_ordered(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    order = ["o_orderdate", "o_orderkey"]
    return reduce_to_budget(orders, "limit", threshold_bytes=BUDGET_BYTES, order_by=order)


def reduce_sample_by_key_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Every third key is NULL; these rows stay or go together."""
    events = table(spark, folder, "events")
    key = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    return reduce_to_budget(events, "sample", threshold_bytes=BUDGET_BYTES, key=key)


def reduce_limit_narrowed(spark: SparkSession, folder: str) -> DataFrame:
    """First rows by a number, by a string and by a lead with many ties, candidates cut down first."""
    orders = table(spark, folder, "orders").withColumn("o_year", F.year("o_orderdate"))
    leads = {"number": "o_custkey", "string": "o_orderpriority", "ties": "o_year"}
    return union_all(
        ordered_head(orders, HEAD_ROWS, [lead, "o_orderkey"], narrow_above=1_000)
        .select(F.lit(label).alias("lead"), "o_orderkey", "o_custkey", "o_orderpriority")
        for label, lead in leads.items()
    )


def _sample_facts(whole: DataFrame, sample: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows of the whole; whether a sample holds nothing else, once each, and about its share."""
    sample = settle(sample.select(key))
    rows, taken = whole.count(), sample.count()
    subset = sample.distinct().join(whole, key, "left_semi").count() == taken
    near = abs(taken - rows * fraction) <= 5 * (rows * fraction * (1 - fraction)) ** 0.5
    return whole.sparkSession.createDataFrame(
        [(rows, subset, near)], "n_rows bigint, subset boolean, near boolean"
    )


def reduce_sample(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    reduced = reduce_to_budget(orders, "sample", threshold_bytes=BUDGET_BYTES, seed=1)
    share = sample_fraction(dataset_size(orders).bytes, BUDGET_BYTES)
    return _sample_facts(orders, reduced, "o_orderkey", share)


def sample_fixed_fraction(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return _sample_facts(events, example_table(events, EVENT_GRIDS), "event_id", EXAMPLE_FRACTION)


# --- sources -----------------------------------------------------------------------


def scan_table(spark: SparkSession, folder: str) -> DataFrame:
    name = _name("orders")
    spark.catalog.createTable(name, os.path.join(folder, "orders.parquet"), "parquet")
    return read_from_table(spark, name)


def scan_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return read_from_path(spark, os.path.join(folder, "orders.parquet"))


def scan_format(fmt: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _file_copy(spark, table(spark, folder, "customer"), fmt)

    return query


def scan_text(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "customer").select(F.col("c_name").alias("value"))
    return _file_copy(spark, names, "txt")


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with quotes and line breaks, through csv and back."""
    return _file_copy(spark, table(spark, folder, "documents"), "csv", multiLine=True)


def _scattered(spark: SparkSession, folder: str) -> str:
    """`customer` as csv at a path, in a folder below and in one below that; the path."""
    path = scratch_path(spark, "scattered")
    customer = table(spark, folder, "customer")
    for part, place in enumerate((path, f"{path}/more", f"{path}/more/yet")):
        rows = customer.where(F.col("c_custkey") % 3 == part)
        write_csv(spark, rows, place, mode="append")
    return path


def scan_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of files at several depths, the format inferred."""
    schema = table(spark, folder, "customer").schema
    return read_from_path(spark, _scattered(spark, folder), schema=schema)


def scan_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Text files lie beside the data and are not read."""
    path = _scattered(spark, folder)
    notes = table(spark, folder, "nation").select("n_name")
    notes.write.mode("append").text(path)
    notes.write.mode("append").text(f"{path}/more")
    return read_from_path(spark, path, schema=table(spark, folder, "customer").schema)


def scan_compressed(spark: SparkSession, folder: str) -> DataFrame:
    """Compressed csv files beside plain ones and notes, the format inferred."""
    path, customer = scratch_path(spark, "compressed"), table(spark, folder, "customer")
    for part, codec in enumerate(("gzip", "bzip2", "none")):
        write_csv(spark, customer.where(F.col("c_custkey") % 3 == part), path, mode="append", compression=codec)
    table(spark, folder, "nation").select("n_name").write.mode("append").option("compression", "gzip").text(path)
    return read_from_path(spark, path, schema=customer.schema)


def scan_partitions_beside(spark: SparkSession, folder: str) -> DataFrame:
    """Plain files beside partitions of the path and of a folder below: the keys stay columns."""
    path, customer = scratch_path(spark, "beside"), table(spark, folder, "customer")
    write_csv(spark, customer.where("c_custkey % 3 = 0"), path, mode="append")
    write_csv(spark, customer.where("c_custkey % 3 = 0 AND c_custkey < 50"), f"{path}/plain", mode="append")
    for part, place, key in ((1, path, "c_mktsegment"), (2, f"{path}/more/yet", "c_nationkey")):
        kept = customer.where(F.col("c_custkey") % 3 == part).withColumn("kept_" + key, F.col(key))
        kept.write.mode("append").option("header", True).partitionBy("kept_" + key).csv(place)
    return read_from_path(spark, path, schema=customer.schema)


def _copied(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """A copy of `lineitem` in several files, and what its rows say of these."""
    path = scratch_path(spark, "copied")
    table(spark, folder, "lineitem").write.partitionBy("l_returnflag").parquet(path)
    facts = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    rows = spark.read.parquet(path).select(*facts).groupBy("path", "size")
    return path, rows.agg(F.count(F.lit(1)).alias("n"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files listed, and whether their sizes are those that a scan reports."""
    path, scanned = _copied(spark, folder)
    listed = file_inventory(spark, path).select("path", "length")
    both = listed.join(scanned, "path", "full")
    same = F.coalesce(F.col("size") == F.col("length"), F.lit(False))
    return both.agg(F.sum("n").alias("n_rows"), F.every(same).alias("sizes_agree"))


def path_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The format of a copy, and whether its bytes are those that a scan reports."""
    path, scanned = _copied(spark, folder)
    found = survey_path(spark, path)
    return scanned.agg(F.sum("n").alias("n_rows"), F.sum("size").alias("bytes")).select(
        "n_rows",
        F.lit(found.format).alias("format"),
        (F.col("bytes") == found.n_bytes).alias("bytes_agree"),
    )


def census(spark: SparkSession, folder: str) -> DataFrame:
    """Extensions of a listing built from `part`: one file per part, the type as its format."""
    listing = table(spark, folder, "part").select(
        F.concat_ws("/", F.lit("store.v1"), "p_brand", F.concat_ws(".", "p_name", "p_type")).alias(
            "path"
        ),
        F.col("p_size").cast("bigint").alias("length"),
    )
    return format_census(listing)


# --- result types ------------------------------------------------------------------


def _as_frame(spark: SparkSession, result: object, kind_column: bool = True) -> DataFrame:
    """A routed result as a Spark frame with the kind of frame it was."""
    if isinstance(result, DataFrame):
        kind, df = "spark", result
    elif hasattr(result, "to_spark"):
        kind, df = "pandas_on_spark", result.to_spark()
    else:
        kind, df = "pandas", as_spark(spark, result)
    return df.withColumn("kind", F.lit(kind)) if kind_column else df


def route_lazy(spark: SparkSession, folder: str) -> DataFrame:
    return _as_frame(spark, read_from_path(spark, os.path.join(folder, "supplier.parquet")))


def route_within(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as pandas while they fit the default threshold, else as pandas on Spark."""
    path = os.path.join(folder, "supplier.parquet")
    return _as_frame(spark, read_from_path(spark, path, as_pandas=True), kind_column=False)


def route_over(spark: SparkSession, folder: str) -> DataFrame:
    path = os.path.join(folder, "orders.parquet")
    result = read_from_path(spark, path, as_pandas=True, threshold_bytes=BUDGET_BYTES)
    return _as_frame(spark, result)


def route_forced(spark: SparkSession, folder: str) -> DataFrame:
    """Rows collected when orders are forced into the budget by a limit."""
    path = os.path.join(folder, "orders.parquet")
    result = read_from_path(
        spark,
        path,
        as_pandas=True,
        threshold_bytes=BUDGET_BYTES,
        force_pandas=True,
        force_method="limit",
    )
    return _as_frame(spark, result).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


# --- sinks -------------------------------------------------------------------------


def save_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return _saved(spark, table(spark, folder, "customer"))


def save_append_twice(spark: SparkSession, folder: str) -> DataFrame:
    return _saved(spark, table(spark, folder, "customer"), times=2)


def save_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """A partitioned save, then an append that keeps the table's layout."""
    return _saved(spark, table(spark, folder, "customer"), times=2, partition_by="c_mktsegment")


def save_overwrite_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Two market segments replaced by richer customers alone, the others left as they were."""
    name, customer = _name("replaced"), table(spark, folder, "customer")
    save_as_table(spark, customer, name, table_properties={"partitionBy": "c_mktsegment"})
    rich = customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 1000")
    for _ in range(2):
        save_as_table(spark, rich, name, mode="overwrite_partitions")
    return spark.table(name).select(*customer.columns)


def export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    path = scratch_path(spark, "export")
    export(lineitem, path, target_file_bytes=dataset_size(lineitem, "wire").bytes // 5 + 1)
    return spark.read.parquet(path)


def provision_counts(spark: SparkSession, folder: str) -> DataFrame:
    trips = round_timestamps(table(spark, folder, "events"), EVENT_GRIDS)
    schema = _name("case")
    names = provision(
        spark,
        trips,
        ENVIRONMENTS,
        schema,
        "example_input",
        location=scratch_path(spark, "environments"),
    )
    return union_all(
        spark.read.table(name)
        .groupBy(F.lit(environment).alias("environment"), "rounded_30")
        .agg(F.count(F.lit(1)).alias("n"))
        for environment, name in zip(ENVIRONMENTS, names, strict=True)
    )


# --- profiling ---------------------------------------------------------------------


def _events_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.nullif("user_id", F.lit(7)).alias("user_id"),
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        "props",
    )


def _measures_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumns(
        {
            "l_quantity": F.nullif("l_quantity", F.lit(7.0)),
            "l_discount": F.nullif("l_discount", F.lit(0.0)),
        }
    )


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def profile_overview(spark: SparkSession, folder: str) -> DataFrame:
    return values.overview(_measures_with_gaps(spark, folder), duplicate_columns=list(ALIKE))


def profile_overview_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are alike but for their ids, by digest."""
    documents = table(spark, folder, "documents")
    return values.overview(documents, by_values=False, duplicate_columns=list(ALIKE_TEXTS))


def profile_overview_exact(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return values.overview(documents, duplicate_columns=list(ALIKE_TEXTS))


def profile_overview_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The same where the digests met twice are too many to be sent to every executor."""
    documents = table(spark, folder, "documents")
    return values.overview(documents, duplicate_columns=list(ALIKE_TEXTS), broadcast_bytes=0, grouped_rows=0)


def profile_overview_suspects(spark: SparkSession, folder: str) -> DataFrame:
    """The same with only those rows moved whole whose digest was met twice."""
    documents = table(spark, folder, "documents")
    return values.overview(documents, duplicate_columns=list(ALIKE_TEXTS), grouped_rows=0)


def profile_topk_proved(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent values by task summaries, exact counts of candidates and bitmaps."""
    return values.top_values(table(spark, folder, "orders"), k=5, grouped_rows=0)


def profile_distinct_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct whole numbers, close together (as bits) or far apart (by value), and those of other types."""
    lines = _measures_with_gaps(spark, folder)
    far = (F.col("l_partkey") * 1_000_000_007).alias("far")
    negative = F.nullif(50 - F.col("l_linenumber"), F.lit(45)).cast("smallint").alias("small")
    return values.distinct_counts(lines.select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", far, negative), exact=True, grouped_rows=0)


def profile_missing(spark: SparkSession, folder: str) -> DataFrame:
    missing = summary.missing_values(_events_with_gaps(spark, folder))
    return _rounded(missing, share_missing=6)


def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    stats = summary.numeric_statistics(_measures_with_gaps(spark, folder))
    return _rounded(stats, mean=6, stddev=6, sum=2, skewness=6, kurtosis=6)


def profile_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    measures = _measures_with_gaps(spark, folder)
    return _rounded(quantiles.exact_quantiles(measures, points=QUANTILES), value=6)


def profile_quantiles_narrowed(spark: SparkSession, folder: str) -> DataFrame:
    """The same, 16 bits of the values' keys at a time until 2,000 values are left."""
    found = quantiles.exact_quantiles(
        _measures_with_gaps(spark, folder), points=QUANTILES, listed_values=2_000
    )
    return _rounded(found, value=6)


def _large_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers and decimals beyond what a double holds, some of them negative."""
    large = F.lit(9007199254740993)
    amount = F.col("o_totalprice").cast("decimal(30,10)") - F.lit(100000).cast("decimal(30,10)")
    return table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + large).otherwise(-large - F.col("o_orderkey")).alias("large_key"),
        (amount + F.lit("12345678901234567.0123456789").cast("decimal(30,10)")).cast("decimal(38,10)").alias("amount"),
        F.nullif(amount, F.lit(0)).cast("decimal(38,10)").alias("signed"),
    )


def profile_quantiles_typed(spark: SparkSession, folder: str) -> DataFrame:
    """The values around each quantile with all their digits."""
    found = quantiles.typed_quantiles(_large_numbers(spark, folder), points=QUANTILES)
    return found.select("column", "quantile", "lower", "upper")


def profile_quantiles_typed_narrowed(spark: SparkSession, folder: str) -> DataFrame:
    """The same, 16 bits of the values' keys at a time until no more than ten values are left."""
    found = quantiles.typed_quantiles(_large_numbers(spark, folder), points=QUANTILES, listed_values=10)
    return found.select("column", "quantile", "lower", "upper")


def profile_quantiles_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the rank of every sketched quantile is off by less than 0.5% of the rows."""
    measures = _measures_with_gaps(spark, folder)
    found = summary.approx_quantiles(measures, points=QUANTILES).collect()
    checks = []
    for r in found:
        value = present_number(measures, r.column)
        n, allowed = F.count(value), F.lit(0.005)
        near = (F.count_if(value < r.value) <= n * (r.quantile + allowed)) & (
            F.count_if(value <= r.value) >= n * (r.quantile - allowed)
        )
        checks.append(
            F.struct(
                F.lit(r.column).alias("column"), F.lit(r.quantile).alias("quantile"), near.alias("near")
            )
        )
    return facts_frame(measures, checks, "column string, quantile double, near boolean", 10)


def profile_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return values.distinct_counts(_events_with_gaps(spark, folder), exact=True)


def profile_distinct_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Exact distinct counts, and whether the sketched ones are within 20% of them."""
    events = _events_with_gaps(spark, folder)
    exact = values.distinct_counts(events, exact=True)
    sketched = values.distinct_counts(events).withColumnRenamed("n_distinct", "n_sketched")
    off = F.abs(F.col("n_sketched") - F.col("n_distinct"))
    near = off <= 0.2 * F.col("n_distinct")
    return exact.join(sketched, "column").select("column", "n_distinct", near.alias("near"))


def profile_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn("gap", F.nullif("lang", F.lit("en")))
    return _rounded(summary.text_statistics(documents), mean_length=6)


def profile_boolean(spark: SparkSession, folder: str) -> DataFrame:
    return summary.boolean_statistics(_flagged(spark, folder))


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    late = F.when(F.col("l_discount") > 0.02, F.col("l_quantity") > 25)
    return _measures_with_gaps(spark, folder).withColumn("large", late)


def pair_bins_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Two texts, a boolean and two numbers against each other."""
    columns = ["l_returnflag", "l_linestatus", "large", "l_quantity", "l_tax"]
    return shapes.value_pairs(_flagged(spark, folder), columns, bins=10)


def profile_exact_types(spark: SparkSession, folder: str) -> DataFrame:
    """Range and sum of keys beyond what a double holds, and of a decimal."""
    large = table(spark, folder, "orders").select(
        (F.col("o_orderkey") + F.lit(9007199254740993)).alias("large_key"),
        F.col("o_totalprice").cast("decimal(20,2)").alias("price"),
    )
    stats = summary.numeric_statistics(large)
    return stats.select("column", "n", "min_exact", "max_exact", "sum_exact")


def profile_topk(spark: SparkSession, folder: str) -> DataFrame:
    return values.top_values(table(spark, folder, "orders"), k=5)


def profile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    buckets = shapes.histogram(_measures_with_gaps(spark, folder), bins=10)
    return _rounded(buckets, lower=4, upper=4)


def profile_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summary.correlations(_measures_with_gaps(spark, folder)), correlation=6)


def profile_rank_correlation(spark: SparkSession, folder: str, broadcast_values: int = ranks.BROADCAST_VALUES) -> DataFrame:
    found = ranks.rank_correlations(_measures_with_gaps(spark, folder), broadcast_values=broadcast_values)
    return _rounded(found, correlation=6)


def profile_datetime(spark: SparkSession, folder: str) -> DataFrame:
    return union_all(
        summary.temporal_ranges(table(spark, folder, name))
        for name in ("events", "orders", "lineitem")
    )


def pair_bins(spark: SparkSession, folder: str) -> DataFrame:
    return shapes.pair_bins(_measures_with_gaps(spark, folder), bins=10)


def profile_report(spark: SparkSession, folder: str) -> DataFrame:
    """All sections of one whole profile, one metric per row."""
    sections = profile(_flagged(spark, folder), exact=True)
    nothing, column = F.lit(""), F.col("column")
    pair = F.concat_ws("|", "column_a", "column_b")
    cell = F.concat_ws("|", "bucket_a", "bucket_b")

    def metrics(section: str, name, detail, **found) -> DataFrame:
        listed = [
            F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
            for m, v in found.items()
        ]
        return sections[section].select(
            F.lit(section).alias("section"),
            name.alias("column"),
            detail.cast("string").alias("detail"),
            F.inline(F.array(*listed)),
        )

    mean, stddev = F.round("mean", 6), F.round("stddev", 6)
    duplicates = F.col("n_duplicate_rows")
    n = F.col("n")
    return union_all(
        [
            metrics(
                "overview", nothing, nothing, n_rows=F.col("n_rows"), n_duplicate_rows=duplicates
            ),
            metrics("missing", column, nothing, n_missing=F.col("n_missing")),
            metrics("numeric", column, nothing, mean=mean, stddev=stddev),
            metrics("correlations", pair, nothing, correlation=F.round("correlation", 6)),
            metrics("top_values", column, F.col("rank"), n=n),
            metrics("histogram", column, F.col("bucket"), n=n),
            metrics("pair_bins", pair, cell, n=n),
            metrics("datetime", column, nothing, n=n, span_seconds=F.col("span_seconds")),
            metrics(
                "text", column, nothing, n=n, n_empty=F.col("n_empty"), min_length=F.col("min_length"),
                mean_length=F.round("mean_length", 6), max_length=F.col("max_length"),
            ),
            metrics(
                "boolean", column, nothing, n_true=F.col("n_true"), n_false=F.col("n_false"), n_missing=F.col("n_missing")
            ),
            metrics("distinct", column, nothing, n_distinct=F.col("n_distinct")),
            metrics("quantiles", column, F.col("quantile"), value=F.round("value", 6)),
        ]
    )


QUERIES: dict[str, Query] = {
    "ts_ceil_15": ts_ceil(15),
    "ts_ceil_30": ts_ceil(30),
    "ts_ceil_7": ts_ceil(7),
    "ts_ceil_90": ts_ceil(90),
    "ts_ceil_seconds": ts_ceil_seconds,
    "round_two_grids": round_two_grids,
    "epoch_to_ts": epoch_to_ts,
    "drop_columns": drop_columns,
    "temp_view": temp_view,
    "feature_lookup": feature_lookup,
    "feature_lookup_missing": feature_lookup_missing,
    "feature_lookup_shuffle": partial(feature_lookup, strategy="shuffle"),
    "feature_lookup_hot": feature_lookup_hot,
    "feature_lookup_hot_shuffle": partial(feature_lookup_hot, strategy="shuffle"),
    "feature_lookup_as_of": feature_lookup_as_of,
    "feature_lookup_as_of_hot": partial(feature_lookup_as_of, part_rows=100),
    "row_count": row_count,
    "size_exact": size_exact,
    "size_estimate": size_estimate,
    "is_oversized": oversized,
    "reduce_sample_by_key": reduce_sample_by_key,
    "reduce_sample_by_key_nulls": reduce_sample_by_key_nulls,
    "reduce_sample_exact": reduce_sample_exact,
    "reduce_sample_exact_ties": reduce_sample_exact_ties,
    "reduce_limit_ordered": reduce_limit_ordered,
    "reduce_limit_narrowed": reduce_limit_narrowed,
    "reduce_sample": reduce_sample,
    "sample_fixed_fraction": sample_fixed_fraction,
    "scan_table": scan_table,
    "scan_parquet": scan_parquet,
    "scan_csv": scan_format("csv"),
    "scan_tsv": scan_format("tsv"),
    "scan_json": scan_format("json"),
    "scan_orc": scan_format("orc"),
    "scan_text": scan_text,
    "scan_nested": scan_nested,
    "scan_mixed": scan_mixed,
    "scan_compressed": scan_compressed,
    "scan_partitions_beside": scan_partitions_beside,
    "csv_roundtrip": csv_roundtrip,
    "file_inventory": inventory,
    "path_summary": path_summary,
    "format_census": census,
    "route_lazy": route_lazy,
    "route_within": route_within,
    "route_over": route_over,
    "route_forced": route_forced,
    "save_roundtrip": save_roundtrip,
    "save_append_twice": save_append_twice,
    "save_partitioned": save_partitioned,
    "save_overwrite_partitions": save_overwrite_partitions,
    "export_roundtrip": export_roundtrip,
    "provision_counts": provision_counts,
    "profile_overview": profile_overview,
    "profile_overview_text": profile_overview_text,
    "profile_overview_exact": profile_overview_exact,
    "profile_overview_shuffled": profile_overview_shuffled,
    "profile_overview_suspects": profile_overview_suspects,
    "profile_topk_proved": profile_topk_proved,
    "profile_distinct_whole": profile_distinct_whole,
    "profile_missing": profile_missing,
    "profile_numeric": profile_numeric,
    "profile_quantiles": profile_quantiles,
    "profile_quantiles_narrowed": profile_quantiles_narrowed,
    "profile_quantiles_typed": profile_quantiles_typed,
    "profile_quantiles_typed_narrowed": profile_quantiles_typed_narrowed,
    "profile_exact_types": profile_exact_types,
    "profile_quantiles_approx": profile_quantiles_approx,
    "profile_distinct": profile_distinct,
    "profile_distinct_approx": profile_distinct_approx,
    "profile_topk": profile_topk,
    "profile_histogram": profile_histogram,
    "profile_correlation": profile_correlation,
    "profile_rank_correlation": profile_rank_correlation,
    "profile_rank_correlation_joined": partial(profile_rank_correlation, broadcast_values=0),
    "profile_datetime": profile_datetime,
    "pair_bins": pair_bins,
    "pair_bins_mixed": pair_bins_mixed,
    "profile_text": profile_text,
    "profile_boolean": profile_boolean,
    "profile_report": profile_report,
}
