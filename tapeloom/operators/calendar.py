"""Trading calendars and as-of lookups.

A calendar holds one row per trading day: a few hundred a year however large
the panel is. That bound, and nothing else, is why calendars are broadcast and
numbered in one partition here.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..contracts import fixed_values as fixed
from ..functions import dates

def _line() -> WindowSpec:
    return Window.orderBy("trade_date")


def trading_days(df: DataFrame) -> DataFrame:
    """Distinct dates of a panel."""
    return df.select("trade_date").where(F.col("trade_date").isNotNull()).distinct()


def number_days(calendar: DataFrame) -> DataFrame:
    """``trade_date`` with ``day_no`` from 1 and ``n_days``."""
    return calendar.select(
        "trade_date",
        F.row_number().over(_line()).alias("day_no"),
        F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("n_days"),
    )


def previous_trade_dates(calendar: DataFrame) -> DataFrame:
    """Every trade date with the one before it."""
    return calendar.select(
        "trade_date", F.lag("trade_date").over(_line()).alias("prev_trade_date")
    )


def previous_trade_date(df: DataFrame, day: date | str) -> DataFrame:
    """One row: the greatest date below ``day``, NULL when there is none."""
    return df.where(F.col("trade_date") < F.lit(day).cast("date")).agg(
        F.max("trade_date").alias("prev_trade_date")
    )


def recent_dates(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest distinct dates, newest first."""
    return trading_days(df).orderBy(F.col("trade_date").desc()).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def latest_trade_date(
    moments: DataFrame,
    calendar: DataFrame,
    moment: str | Column,
    close_time: str = fixed.MARKET_CLOSE,
    source_zone: str | None = None,
) -> DataFrame:
    """Add ``latest_trade_date``: the last finished trading day as of each moment.

    The as-of search is an equality join: the calendar is widened to one row per
    natural day, each carrying its latest trading day. Moments after the
    calendar's end take its last day, moments before its start get NULL.
    """
    following = F.lead("trade_date").over(_line())
    by_day = calendar.select(
        F.col("trade_date").alias("latest_trade_date"),
        F.coalesce(F.date_sub(following, 1), F.col("trade_date")).alias("_until"),
    ).select(
        F.explode(F.expr("sequence(latest_trade_date, _until, interval 1 day)")).alias("_day"),
        "latest_trade_date",
    )
    column = F.col(moment) if isinstance(moment, str) else moment
    last_day = calendar.agg(F.max("trade_date")).scalar()
    asked = moments.withColumn(
        "_day", F.least(dates.effective_date(column, close_time, source_zone), last_day)
    )
    return asked.join(F.broadcast(by_day), "_day", "left").drop("_day")
