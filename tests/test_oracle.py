"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from tests.conftest import TABLES
from tests.oracle import assert_same, connect

QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(TABLES)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, folder, duck, name):
    assert assert_same(QUERIES[name](spark, folder), duck, SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("name", ["round_two_grids", "ts_ceil_7", "epoch_to_ts", "feature_lookup"])
def test_wall_clock_results_do_not_depend_on_the_session_zone(
    spark, folder, duck, setting, zone, name
):
    setting("spark.sql.session.timeZone", zone)
    assert_same(QUERIES[name](spark, folder), duck, SQL[name])


def test_entry_is_stable(spark):
    first, second = entry_point.entry(spark), entry_point.entry(spark)
    assert first.schema == second.schema
    assert first.count() == second.count() > 0
