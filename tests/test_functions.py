"""Golden values of the column expressions, one row per case."""

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import dates, limits, numbers, tickers


def values(spark, inputs, expression, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {dtype}")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_ticker_rules(spark):
    given = ["1", " 600000 ", "600000", "000001.SZ", "430001", "510300", "400001", "12345678", None]
    assert values(spark, given, tickers.format_ticker) == [
        "000001", "600000", "600000", "000001.SZ", "430001", "510300", "400001", "12345678", None
    ]
    assert values(spark, given, tickers.exchange) == [
        "SZ", "SH", "SH", "SZ", "BJ", "SH", "UNKNOWN", "SZ", None
    ]
    assert values(spark, given, tickers.suffix_history) == [
        "000001.SZ", "600000.SH", "600000.SH", "000001.SZ", "430001.BJ", "510300", "400001.BJ",
        "12345678", None,
    ]
    # the daily rule does not trim
    assert values(spark, given, tickers.suffix_daily)[1] == " 600000 "
    assert values(spark, ["600000.SH", " 600000.sh", "600000", None], tickers.is_suffixed_ticker) == [
        True, True, False, False
    ]
    assert values(spark, ["600000", "60000", None], tickers.is_bare_ticker) == [True, False, False]
    assert values(spark, ["600000.SH"], tickers.bare_code) == ["600000"]
    assert values(spark, ["600000", "000001", "430001"], tickers.is_bj_ticker) == [False, False, True]


def test_st_names(spark):
    assert values(spark, ["*ST A", "st b", "FaSt", "plain", None], tickers.is_st) == [
        True, True, True, False, False
    ]


def test_dates(spark):
    given = ["2024-01-05", "20240105", "2024/01/05", "2024-1-5", "20240230", "", "-", None,
             "2024-01/05", "2024", "2024-01-05x"]
    got = [str(v) if v else None for v in values(spark, given, dates.parse_date)]
    assert got == ["2024-01-05"] * 4 + [None] * 7
    timed = values(spark, ["2024-01-05 10:00:00", "2024-01-05T9:30", "2024-01-05 25:00"],
                   lambda c: dates.parse_date(c, with_time=True))
    assert [str(v) if v else None for v in timed] == ["2024-01-05", "2024-01-05", None]
    assert values(spark, ["20240101", "2024/01/01"], dates.format_date) == ["2024-01-01"] * 2
    assert values(spark, ["20240101"], lambda c: dates.format_date(c, to_format="%Y/%m/%d")) == [
        "2024/01/01"
    ]
    assert values(spark, ["05.01.2024"], lambda c: dates.format_date(c, "%d.%m.%Y")) == ["2024-01-05"]
    with pytest.raises(Exception, match="cannot read date"):
        values(spark, ["05.01.2024"], dates.format_date)
    with pytest.raises(Exception, match="not a yyyyMMdd date"):
        values(spark, ["2024-01-05"], dates.compact_date)


def test_numbers(spark):
    given = ["1.5", " 1.5 ", "1e3", "-", "", "1,234", "1.5f", "nan", "inf", "0x10", None]
    assert values(spark, given, numbers.to_number) == [
        1.5, 1.5, 1000.0, None, None, None, None, None, float("inf"), None, None
    ]
    assert values(spark, ["2.5", "2.7", "3.5", "inf"], lambda c: numbers.to_whole(c.cast("double"))) == [
        2, 3, 4, None
    ]
    strict = lambda c: numbers.to_number(c, errors="raise")
    assert values(spark, ["1", "", "nan", None], strict) == [1.0, None, None, None]
    with pytest.raises(Exception, match="not a number"):
        values(spark, ["x1"], strict)


def test_booleans(spark):
    given = ["1", "True", "YES", "是", "0", "no", "否", "1.0", "maybe", None]
    assert values(spark, given, numbers.to_boolean) == [
        True, True, True, True, False, False, False, None, None, None
    ]
    own = lambda c: numbers.to_boolean(c, {"maybe"}, {"1"})
    assert values(spark, ["maybe", "1", "0"], own) == [True, False, None]


def test_limit_prices_round_half_to_even_on_the_double(spark):
    rate = F.lit(0.0)
    got = values(spark, [10.625, 2.345, 1.005], lambda c: limits.limit_up_price(c, rate), "double")
    assert got == [10.62, 2.35, 1.0]


@pytest.mark.parametrize(
    "ticker, st, rate",
    [("600001.SH", False, 10.0), ("600001.SH", True, 5.0), ("300001.SZ", True, 20.0),
     ("301001.SZ", False, 20.0), ("689009.SH", False, 20.0), ("430001.BJ", True, 30.0),
     ("830001.BJ", False, 30.0), ("920001.BJ", False, 30.0), ("510300", True, 10.0)],
)
def test_limit_rates(spark, ticker, st, rate):
    row = spark.range(1).select(limits.limit_rate(F.lit(ticker), F.lit(st)).alias("r")).first()
    assert row.r == rate


def test_limit_flags(spark):
    rows = spark.createDataFrame(
        [(10.99, 9.9, "600001.SH", False), (11.0, 9.9, "600001.SH", False), (11.01, 9.89, "600001.SH", False),
         (10.5, 4.9, "600002.SH", True), (12.0, 19.9, "688001.SH", False), (12.0, 19.8, "301001.SZ", False),
         (9.0, -9.9, "000001.SZ", False), (10.0, None, "000001.SZ", False)],
        "close double, pct double, ticker string, st boolean",
    )
    up = limits.limit_up_price(F.lit(10.0), limits.limit_rate(F.col("ticker"), F.col("st")))
    down = limits.limit_down_price(F.lit(10.0), limits.limit_rate(F.col("ticker"), F.col("st")))
    got = rows.select(
        limits.price_limit_up(F.col("close"), up).alias("u"),
        limits.price_limit_down(F.col("close"), down).alias("d"),
        limits.pct_limit_up(F.col("pct"), F.col("ticker"), F.col("st")).alias("pu"),
        limits.pct_limit_down(F.col("pct"), F.col("ticker"), F.col("st")).alias("pd"),
    ).collect()
    assert [r.u for r in got] == [False, True, True, True, True, True, False, False]
    assert [r.d for r in got] == [False] * 6 + [True, False]
    assert [r.pu for r in got] == [True, True, False, True, True, True, False, False]
    assert [r.pd for r in got] == [False] * 6 + [True, False]
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        limits.price_limit_up(F.lit(1.0), none).alias("a"),
        limits.fill_change_pct(none, F.lit(1.0), F.lit(0.0)).alias("b"),
        limits.nominal_limit_up_pct(F.lit(True)).alias("c"),
        limits.nominal_limit_down_pct(F.lit(False)).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (False, None, 5.0, -10.0)


def test_market_clock(spark):
    given = ["2024-01-05 06:59:59", "2024-01-05 07:00:00", "2024-01-05 16:30:00"]
    got = values(spark, given, lambda c: dates.effective_date(c.cast("timestamp_ntz"), source_zone="UTC"))
    assert [str(v) for v in got] == ["2024-01-04", "2024-01-05", "2024-01-05"]
    later = values(
        spark, given[1:2],
        lambda c: dates.effective_date(c.cast("timestamp_ntz"), close_time="15:01", source_zone="UTC"),
    )
    assert str(later[0]) == "2024-01-04"
