from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import round_timestamps
from plumbline.functions.timegrid import (
    ceil_to_grid,
    ceil_to_grid_seconds,
    seconds_to_timestamp,
    wall_clock_seconds,
)
from tests.conftest import plan_of

EDGES = [
    ("2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
    ("2024-01-01 00:15:00", "2024-01-01 00:15:00", "2024-01-01 01:30:00"),
    ("2024-01-01 00:15:00.000001", "2024-01-01 00:30:00", "2024-01-01 01:30:00"),
    ("2024-01-01 23:59:59.999999", "2024-01-02 00:00:00", "2024-01-02 00:30:00"),
    ("2024-02-29 23:50:00", "2024-03-01 00:00:00", "2024-03-01 00:30:00"),
    ("1969-12-31 23:50:01", "1970-01-01 00:00:00", "1970-01-01 00:30:00"),
    (None, None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_edges_for_both_timestamp_types(spark, setting, kind, zone):
    setting("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame(EDGES, "ts string, n15 string, n90 string")
    ts = F.col("ts").cast(kind)
    got = df.select(
        ceil_to_grid(ts, 15).alias("a"), ceil_to_grid(ts, 90).alias("b"), "n15", "n90"
    )
    assert dict(got.dtypes)["a"] == kind
    for row in got.select(F.col("a").cast("string"), F.col("b").cast("string"), "n15", "n90").collect():
        assert (row.a, row.b) == (row.n15, row.n90)


def _by_definition(ts: dt.datetime, minutes: int) -> dt.datetime:
    hour = ts.replace(minute=0, second=0, microsecond=0)
    gone = (ts - hour) // dt.timedelta(microseconds=1)
    step = minutes * 60_000_000
    return hour + dt.timedelta(microseconds=math.ceil(gone / step) * step)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    stamps=st.lists(
        st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)), min_size=1, max_size=40
    ),
    minutes=st.integers(1, 200),
)
def test_matches_the_definition(spark, stamps, minutes):
    df = spark.createDataFrame([(str(s),) for s in stamps], "ts string")
    rounded = ceil_to_grid(F.col("ts").cast("timestamp_ntz"), minutes).cast("string")
    got = [dt.datetime.fromisoformat(r[0]) for r in df.select(rounded).collect()]
    assert got == [_by_definition(s, minutes) for s in stamps]


def test_daylight_saving_changes(spark, setting):
    setting("spark.sql.session.timeZone", "America/New_York")
    # Epoch seconds around the spring gap and both passes of the repeated autumn hour.
    cases = {
        1710053400 + 1: "2024-03-10 01:59:59",
        1710053999: None,
        1730611801: None,
        1730615401: None,
    }
    df = spark.createDataFrame([(s,) for s in cases], "s bigint")
    row_step = 15 * 60
    got = df.select("s", F.unix_seconds(ceil_to_grid(F.timestamp_seconds("s"), 15)).alias("r"))
    for row in got.collect():
        assert row.r == -(-row.s // row_step) * row_step


def test_step_may_be_a_column(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:16:00' ts, n FROM VALUES (15), (30), (7) t(n)")
    got = [str(r[0]) for r in df.select(ceil_to_grid("ts", F.col("n"))).collect()]
    assert got == ["2024-01-01 00:30:00", "2024-01-01 00:30:00", "2024-01-01 00:21:00"]


@pytest.mark.parametrize("minutes", [0, -5, True])
def test_bad_steps_are_refused(minutes):
    with pytest.raises(ValueError):
        ceil_to_grid(None, minutes)


def test_seconds_outlast_32_bits_and_go_back(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2100-05-01 10:01:00.5' ts")
    row = df.select(
        ceil_to_grid_seconds("ts", 15).alias("s"),
        seconds_to_timestamp(ceil_to_grid_seconds("ts", 15), with_zone=False)
        .cast("string")
        .alias("back"),
    ).first()
    assert row.s == 4112849700 and row.back == "2100-05-01 10:15:00"


def test_seconds_to_an_instant(spark):
    df = spark.sql("SELECT 1704067200 s").select(seconds_to_timestamp("s").alias("t"))
    assert df.dtypes == [("t", "timestamp")]
    assert df.select(F.unix_seconds("t")).first()[0] == 1704067200


def test_wall_clock_seconds_floor_before_1970(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:58.5' ts")
    assert df.select(wall_clock_seconds("ts")).first()[0] == -2


def test_round_timestamps_replaces_sources_and_publishes_a_view(spark, folder, fresh):
    view = fresh("view")
    events = spark.read.parquet(f"{folder}/events.parquet")
    got = round_timestamps(events, {"ts": [("a", 15), ("b", 30)]}, view=view)
    assert got.columns == ["event_id", "user_id", "event_type", "value", "props", "a", "b"]
    assert spark.table(view).count() == events.count()


def test_round_timestamps_in_place_and_twice_named(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert "ts" in round_timestamps(events, {"ts": ("ts", 15)}).columns
    with pytest.raises(ValueError):
        round_timestamps(events, {"ts": [("a", 15), ("a", 30)]})


def test_rounding_is_one_projection_inside_codegen(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    got = round_timestamps(events.select("event_id", "ts"), {"ts": [("a", 15), ("b", 30)]})
    plan = plan_of(got)
    assert "Python" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
    assert "Project [codegen id" in plan


def test_rounding_works_on_a_stream(spark, folder, fresh):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    name = fresh("stream")
    query = (
        round_timestamps(stream, {"ts": ("slot", 15)})
        .writeStream.format("memory")
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    batch = round_timestamps(spark.read.parquet(f"{folder}/events.parquet"), {"ts": ("slot", 15)})
    assert spark.table(name).exceptAll(batch).count() == 0
    assert spark.table(name).count() == batch.count()
