"""Review tables: dashboard, stock view, journal."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import fixed_values as fixed
from ..functions import tickers
from ..operators import market, series
from ..sources.store import between_days

Day = date | str


def flagged_view(panel: DataFrame) -> DataFrame:
    """Panel with price-limit flags, broken limits and candle states, row by row.

    Needs pre_close and pct_change; carried rows, when marked, are left out.
    """
    if "is_carried" in panel.columns:
        panel = panel.where("not coalesce(is_carried, false)").drop("is_carried")
    flagged = market.flag_limits_by_price(market.flag_st(panel), keep_prices=True)
    return market.add_candle_state(market.flag_broken(flagged))


def market_view(panel: DataFrame) -> DataFrame:
    """``flagged_view`` with board streaks."""
    return series.board_streak(flagged_view(panel))


def dashboard(
    view: DataFrame,
    phases: DataFrame | None = None,
    themes: DataFrame | None = None,
    k: int = 10,
) -> dict[str, DataFrame]:
    """The dashboard's tables; ``view`` comes from ``market_view``."""
    kpis = market.market_kpis(view)
    return {
        "kpis": kpis if phases is None else market.with_phase(kpis, phases),
        "limit_up_pool": market.limit_up_pool(view, themes),
        "limit_down_pool": market.limit_down_pool(view),
        "big_losers": market.big_losers(view, k),
    }


def dashboard_days(
    view: DataFrame,
    phases: DataFrame | None = None,
    themes: DataFrame | None = None,
    k: int = 10,
) -> DataFrame:
    """The whole dashboard in one pass: a row for each day.

    Breadth and phase; ``limit_up_pool``, ``limit_down_pool`` and ``losers`` as ordered arrays of what the
    functions of these names give as rows. One aggregation reads the view once. Losers are
    ranked as rows where the day's rows lie, so that arrays hold what the pages show and no
    whole day; themes and phases join by day.
    """
    code, pct = F.col("ticker").alias("ts_code"), F.col("pct_change")

    def ordered(when: Column, order: list[Column], *columns) -> Column:
        # NULLs last: whether a value is missing comes before the value
        keys = [x for c in order for x in (c.isNull(), c)]
        row = F.struct(F.struct(*keys).alias("_order"), F.struct(*columns).alias("row"))
        return F.transform(F.sort_array(F.collect_list(F.when(when, row))), lambda x: x["row"])

    worst = Window.partitionBy("trade_date").orderBy(pct.asc_nulls_last(), "ticker")
    days = view.withColumn("_place", F.row_number().over(worst)).groupBy("trade_date").agg(
        *market.kpi_columns(),
        ordered(F.col("is_limit_up"), [-F.col("boards"), -F.col("amount"), F.col("ticker")],
                code, "name", "boards", "amount").alias("limit_up_pool"),
        ordered(F.col("is_limit_down"), [pct, F.col("ticker")], code, "name", "pct_change", "amount")
        .alias("limit_down_pool"),
        ordered(pct.isNotNull() & (F.col("_place") <= k), [pct, F.col("ticker")], code, "name", "pct_change")
        .alias("losers"),
    )
    theme = F.lit(None).cast("string")
    if themes is not None:
        by_day = themes.groupBy("trade_date").agg(
            F.map_from_entries(F.collect_list(F.struct("code", "theme"))).alias("_themes"))
        days = days.join(by_day, "trade_date", "left")

    def with_theme(x: Column) -> Column:
        found = theme if themes is None else F.try_element_at(
            F.col("_themes"), tickers.without_suffix(x["ts_code"]))
        return F.struct(*[x[c].alias(c) for c in ("ts_code", "name", "boards", "amount")], found.alias("theme"))

    days = days.withColumn("limit_up_pool", F.transform("limit_up_pool", with_theme)).drop("_themes")
    return days if phases is None else market.with_phase(days, phases)


def stock_view(
    view: DataFrame,
    ticker: str | None = None,
    notes: DataFrame | None = None,
    lengths: Sequence[int] = fixed.MOVING_AVERAGE_LENGTHS,
    start: Day | None = None,
    end: Day | None = None,
    places: int | None = None,
) -> DataFrame:
    """Bars with averages and candle states, beside the stock's notes.

    The ticker and the end date filter below the windows. The start date filters
    above them: averages at its first days need the rows before it.
    """
    if ticker is not None:
        view = view.where(view.ticker == ticker)
    shown = series.moving_averages(between_days(view, end_date=end), lengths, places=places)
    shown = between_days(shown, start_date=start)
    return shown if notes is None else market.attach_notes(shown, notes)
