"""Loaders over stocks past 100,000, whose codes have a class part."""

import os

import pytest

from tapeloom.driver import ORACLES, QUERIES
from tapeloom.functions import tickers
from tapeloom.operators import quality
from tests import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A month of lines; every other stock is one past 100,000."""
    folder = str(tmp_path_factory.mktemp("many"))
    con = compare.duck(SMALL)
    shifted = "{0} + if({0} % 2 = 0, 123000, 0) AS {0}"
    con.execute(
        f"COPY (SELECT * REPLACE ({shifted.format('l_suppkey')}) FROM lineitem"
        f" WHERE l_shipdate < DATE '1995-02-01') TO '{folder}/lineitem.parquet'")
    con.execute(
        f"COPY (SELECT * REPLACE ({shifted.format('s_suppkey')}) FROM supplier) TO '{folder}/supplier.parquet'")
    for table in compare.TABLES:
        if table not in ("lineitem", "supplier"):
            os.symlink(f"{SMALL}/{table}.parquet", f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize(
    "name", ["load_daily_files", "stream_daily_files", "load_chosen_files", "load_history_files"])
def test_loaders_take_stocks_past_100000(spark, many, name):
    con = compare.duck(many)
    held = con.execute(f"SELECT count(DISTINCT ticker) FROM ({ORACLES[name]}) WHERE ticker LIKE '%-123.%'").fetchone()
    assert held[0] > 1
    assert compare.difference(QUERIES[name](spark, many), con, ORACLES[name]) is None


def test_a_class_part_is_part_of_the_market_s_rule_alone(spark):
    texts = ["600008-123.SH", "600008.SH", "600008-.SH", "600008-0.SH", "60008-1.SH", "600008-123", None]
    rows = spark.createDataFrame([(t,) for t in texts], "ticker string").selectExpr(
        "ticker", "date'2024-01-02' AS trade_date")
    broken = quality.quality_report(rows, form=tickers.is_class_ticker).where("rule = 'ticker_format'").collect()
    assert {r.ticker for r in broken} == {*texts[2:]}
    broken = quality.quality_report(rows).where("rule = 'ticker_format'").collect()
    assert {r.ticker for r in broken} == {texts[0], *texts[2:]}
