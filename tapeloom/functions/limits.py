"""Percent change and price-limit rules (Column -> Column).

Two families of limit flags exist and disagree on purpose: by percent threshold
(``pct_limit_*``) and by limit price (``price_limit_*``). Market views use the
latter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import fixed_values as fixed
from .tickers import starts_with_any


def change_pct(close: Column, pre_close: Column) -> Column:
    """(close - pre_close) / pre_close in percent; NULL without a usable base."""
    return F.when(pre_close != 0, (close - pre_close) / pre_close * F.lit(100.0))


def fill_change_pct(pct: Column, close: Column, pre_close: Column) -> Column:
    return F.when(pct.isNull(), change_pct(close, pre_close)).otherwise(pct)


def _threshold(ticker: Column, st: Column, sign: float) -> Column:
    return (
        F.when(st, F.lit(sign * fixed.ST_THRESHOLD))
        .when(
            F.substring(ticker, 1, 3).isin(*fixed.GROWTH_THRESHOLD_PREFIXES),
            F.lit(sign * fixed.GROWTH_THRESHOLD),
        )
        .otherwise(F.lit(sign * fixed.PLAIN_THRESHOLD))
    )


def pct_limit_up(pct: Column, ticker: Column, st: Column) -> Column:
    return F.coalesce(pct >= _threshold(ticker, st, 1.0), F.lit(False))


def pct_limit_down(pct: Column, ticker: Column, st: Column) -> Column:
    return F.coalesce(pct <= _threshold(ticker, st, -1.0), F.lit(False))


def limit_rate(ticker: Column, st: Column) -> Column:
    """Daily price limit of a board in percent; main-board ST comes first."""
    return (
        F.when(st & starts_with_any(ticker, fixed.MAIN_BOARD_PREFIXES), F.lit(fixed.ST_RATE))
        .when(starts_with_any(ticker, fixed.BJ_BOARD_PREFIXES), F.lit(fixed.BJ_BOARD_RATE))
        .when(
            starts_with_any(ticker, fixed.GROWTH_BOARD_PREFIXES), F.lit(fixed.GROWTH_BOARD_RATE)
        )
        .otherwise(F.lit(fixed.MAIN_BOARD_RATE))
    )


def _to_cents(price: Column) -> Column:
    # half to even on the scaled double, not decimal rounding: 10.625 -> 10.62
    return F.rint(price * F.lit(100.0)) / F.lit(100.0)


def limit_up_price(pre_close: Column, rate: Column) -> Column:
    return _to_cents(pre_close * (F.lit(1.0) + rate / F.lit(100.0)))


def limit_down_price(pre_close: Column, rate: Column) -> Column:
    return _to_cents(pre_close * (F.lit(1.0) - rate / F.lit(100.0)))


def price_limit_up(close: Column, up_price: Column) -> Column:
    return F.coalesce(close >= up_price - F.lit(fixed.PRICE_TOLERANCE), F.lit(False))


def price_limit_down(close: Column, down_price: Column) -> Column:
    return F.coalesce(close <= down_price + F.lit(fixed.PRICE_TOLERANCE), F.lit(False))


def broken_limit(high: Column, up_price: Column, is_limit_up: Column) -> Column:
    """Touched the limit-up price in the day and closed under it."""
    return F.coalesce(
        (high >= up_price - F.lit(fixed.PRICE_TOLERANCE)) & ~is_limit_up, F.lit(False)
    )


def nominal_limit_up_pct(st: Column) -> Column:
    return F.when(st, F.lit(fixed.LIMIT_UP_ST_PCT)).otherwise(F.lit(fixed.LIMIT_UP_PCT))


def nominal_limit_down_pct(st: Column) -> Column:
    return F.when(st, F.lit(fixed.LIMIT_DOWN_ST_PCT)).otherwise(F.lit(fixed.LIMIT_DOWN_PCT))


def candle_state(
    pct: Column, is_limit_up: Column, is_limit_down: Column, is_broken: Column
) -> Column:
    """limit_up, limit_down, broken, up, down or flat, in that order of precedence."""
    return (
        F.when(is_limit_up, "limit_up")
        .when(is_limit_down, "limit_down")
        .when(is_broken, "broken")
        .when(pct > 0, "up")
        .when(pct < 0, "down")
        .otherwise("flat")
    )
