"""Registered queries against their SQL at the smallest scale, and their plans.

Two queries whose rows the smallest scale lacks run at the next one.
"""

import os

import pytest

from tapeloom.driver import ORACLES, QUERIES, store_queries
from tests.compare import difference, duck, type_difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WRITING = [n for n, f in QUERIES.items() if f.__module__ == store_queries.__name__]
READING = [n for n in QUERIES if n not in WRITING]
LARGER = "/root/testdata/sf0.01"
SCARCE = {"snapshot_day", "ticker_quarantine"}


@pytest.fixture(scope="module")
def connections():
    return {folder: duck(folder) for folder in (SF_DIR, LARGER)}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, connections, name):
    folder = LARGER if name in SCARCE else SF_DIR
    con = connections[folder]
    df = QUERIES[name](spark, folder)
    assert difference(df, con, ORACLES[name]) is None
    assert type_difference(df, con, ORACLES[name]) is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READING)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["dedupe_keep_last", "big_losers"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert plan(QUERIES[name](spark, SF_DIR)).count("WindowGroupLimit") == 2


def test_series_share_one_shuffle_and_sort(spark):
    text = plan(QUERIES["board_streak"](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning(ticker") == 1
    assert text.count("+- Sort [ticker") == 1


def test_scans_read_only_needed_columns(spark):
    text = plan(QUERIES["stock_count"](spark, SF_DIR))
    scan = next(part for part in text.split("FileScan parquet") if "l_suppkey" in part)
    assert "l_extendedprice" not in scan.split("]")[0]
