"""Series, calendar, carry-forward and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, limits
from ..operators import calendar as cal
from ..operators import carry, market, series
from ..plans import daily, history
from ..sources.store import query_panel, query_trades
from . import adapter, sql
from .registry import query

_SNAPSHOT = "trade_date, ticker, name, open, high, low, close, volume, amount"
_OHLC = "open, high, low, close"


# --- stored-panel queries -------------------------------------------------------


@query(sql.LISTED + f" SELECT {_SNAPSHOT} FROM listed ORDER BY trade_date, ticker")
def snapshot_query(spark, sf_dir):
    return query_panel(adapter.listed(spark, sf_dir))


@query(
    sql.LISTED + f" SELECT {_SNAPSHOT} FROM listed WHERE ticker = '600008.SH'"
    " ORDER BY trade_date, ticker"
)
def snapshot_by_ticker(spark, sf_dir):
    return query_panel(adapter.listed(spark, sf_dir), ticker="600008.SH")


@query(
    sql.LISTED + f" SELECT {_SNAPSHOT} FROM listed WHERE trade_date >= DATE '1997-01-01'"
    " AND trade_date <= DATE '1999-12-31' ORDER BY trade_date, ticker"
)
def snapshot_range(spark, sf_dir):
    return query_panel(
        adapter.listed(spark, sf_dir), start_date="1997-01-01", end_date="1999-12-31"
    )


@query(sql.LISTED + f" SELECT {_SNAPSHOT} FROM listed WHERE trade_date = DATE '1999-06-15'")
def snapshot_day(spark, sf_dir):
    return query_panel(adapter.listed(spark, sf_dir), trade_date="1999-06-15")


@query(
    "WITH " + sql.TRADES + " SELECT * FROM trades ORDER BY entry_date NULLS LAST"
)
def trade_query(spark, sf_dir):
    return query_trades(adapter.trades(spark, sf_dir))


@query("WITH " + sql.TRADES + " SELECT * FROM trades WHERE trade_id = 'T7'")
def trade_by_id(spark, sf_dir):
    return query_trades(adapter.trades(spark, sf_dir), "T7")


@query(
    sql.LISTED + f""" SELECT {_SNAPSHOT} FROM listed WHERE trade_date =
    (SELECT max(trade_date) FROM listed WHERE trade_date < DATE '1999-06-15')"""
)
def previous_day_slice(spark, sf_dir):
    panel = adapter.listed(spark, sf_dir)
    before = cal.previous_trade_date(adapter.days(spark, sf_dir), "1999-06-15").scalar()
    return panel.where(F.col("trade_date") == before)


# --- calendar -------------------------------------------------------------------


@query(
    sql.LISTED + """ SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev_trade_date
    FROM (SELECT DISTINCT trade_date FROM listed)"""
)
def previous_trade_date(spark, sf_dir):
    return cal.previous_trade_dates(cal.trading_days(adapter.listed(spark, sf_dir)))


@query(
    sql.LISTED + " SELECT DISTINCT trade_date FROM listed ORDER BY trade_date DESC LIMIT 5"
)
def recent_dates(spark, sf_dir):
    return cal.recent_dates(adapter.listed(spark, sf_dir), 5)


@query(sql.LISTED + " SELECT DISTINCT trade_date FROM listed")
def trading_days(spark, sf_dir):
    return cal.trading_days(adapter.listed(spark, sf_dir))


@query(sql.LISTED + " SELECT count(*) AS n_rows FROM listed")
def row_count(spark, sf_dir):
    return cal.row_count(adapter.listed(spark, sf_dir))


@query(
    """WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem),
    asked AS (
      SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 8 HOUR AS local
      FROM orders),
    target AS (
      SELECT o_orderkey, CASE WHEN hour(local) < 15 THEN CAST(local AS DATE) - 1
                              ELSE CAST(local AS DATE) END AS day
      FROM asked)
    SELECT o_orderkey, trade_date AS latest_trade_date
    FROM target ASOF LEFT JOIN days ON target.day >= days.trade_date"""
)
def latest_trade_date(spark, sf_dir):
    orders = adapter.read(spark, sf_dir, "orders")
    moments = orders.select(
        "o_orderkey",
        F.timestamp_add("SECOND", (F.col("o_orderkey") % 86400).cast("int"), "o_orderdate").alias(
            "asked_at"
        ),
    )
    return cal.latest_trade_date(
        moments, adapter.days(spark, sf_dir), "asked_at", source_zone="UTC"
    ).drop("asked_at")


@query(
    """WITH asked AS (
      SELECT event_id, ts + INTERVAL 8 HOUR AS local FROM events)
    SELECT event_id, strftime(local, '%Y-%m-%d %H:%M') AS market_time,
           CASE WHEN hour(local) < 15 THEN CAST(local AS DATE) - 1 ELSE CAST(local AS DATE) END
             AS effective_date
    FROM asked"""
)
def market_clock(spark, sf_dir):
    events = adapter.read(spark, sf_dir, "events")
    local = dates.market_time(F.col("ts"), "UTC")
    return events.select(
        "event_id",
        F.date_format(local, "yyyy-MM-dd HH:mm").alias("market_time"),
        dates.effective_date(F.col("ts"), source_zone="UTC").alias("effective_date"),
    )


# --- series ---------------------------------------------------------------------


@query(sql.PANEL + " SELECT trade_date, ticker, close, pre_close FROM panel")
def prev_close(spark, sf_dir):
    return series.previous_close(adapter.listed(spark, sf_dir)).select(
        "trade_date", "ticker", "close", "pre_close"
    )


@query(sql.PANEL + " SELECT trade_date, ticker, close, pre_close, pct_change FROM panel")
def pct_change(spark, sf_dir):
    return adapter.panel(spark, sf_dir).select(
        "trade_date", "ticker", "close", "pre_close", "pct_change"
    )


@query(
    sql.PANEL + """ SELECT trade_date, ticker,
      CASE WHEN volume % 5 = 0 THEN pct_change ELSE
        CASE WHEN pre_close <> 0 THEN (close - pre_close) / pre_close * 100e0 END END AS pct_change
    FROM panel"""
)
def fill_pct_change(spark, sf_dir):
    panel = adapter.panel(spark, sf_dir)
    gappy = panel.withColumn("pct_change", F.when(F.col("volume") % 5 == 0, F.col("pct_change")))
    return gappy.select(
        "trade_date",
        "ticker",
        limits.fill_change_pct(F.col("pct_change"), F.col("close"), F.col("pre_close")).alias(
            "pct_change"
        ),
    )


@query(
    sql.LISTED + """, cut AS (SELECT * FROM listed WHERE trade_date >= DATE '1996-01-01'),
    lagged AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS pre_close FROM cut)
    SELECT trade_date, ticker, open, high, low, close, pre_close,
           (close - pre_close) / pre_close * 100e0 AS pct_change, volume, amount,
           CAST(NULL AS DOUBLE) AS turnover, CAST(NULL AS DOUBLE) AS market_cap,
           CAST(NULL AS DOUBLE) AS float_cap
    FROM lagged WHERE pre_close IS NOT NULL"""
)
def history_derivation(spark, sf_dir):
    return history.derive_history(adapter.listed(spark, sf_dir), start="1996-01-01")


def _ma_sql(lengths):
    parts = ", ".join(
        f"""CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY trade_date
              ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n}
            THEN CAST(sum(CAST(round(close * 10000) AS BIGINT)) OVER (PARTITION BY ticker
              ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS DOUBLE)
              / {n * 10000}e0 END AS ma{n}"""
        for n in lengths
    )
    return sql.LISTED + f" SELECT trade_date, ticker, close, {parts} FROM listed"


@query(_ma_sql((5, 10, 20, 60)))
def moving_averages(spark, sf_dir):
    columns = ["trade_date", "ticker", "close", "ma5", "ma10", "ma20", "ma60"]
    return series.moving_averages(adapter.listed(spark, sf_dir), places=4).select(*columns)


@query(_ma_sql((3, 30)))
def custom_ma(spark, sf_dir):
    return series.moving_averages(adapter.listed(spark, sf_dir), (3, 30), places=4).select(
        "trade_date", "ticker", "close", "ma3", "ma30"
    )


def _exact_ma(n: int) -> str:
    frame = f"(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    total = f"sum(CAST(price * 4611686018427387904e0 AS HUGEINT)) OVER {frame}"
    return (f"CASE WHEN count(price) OVER {frame} = {n} THEN"
            f" (CAST({total} // 4611686018427387904 AS DOUBLE)"
            f" + CAST({total} % 4611686018427387904 AS DOUBLE) / 4611686018427387904e0) / {n}e0 END AS ma{n}")


@query(
    sql.LISTED + f""", thirds AS (SELECT trade_date, ticker, close / 3e0 AS price FROM listed)
    SELECT trade_date, ticker, {_exact_ma(20)}, {_exact_ma(250)} FROM thirds"""
)
def long_ma(spark, sf_dir):
    """Averages of values without end in decimals, summed exactly over up to 250 rows."""
    thirds = adapter.listed(spark, sf_dir).withColumn("price", F.col("close") / 3)
    return series.moving_averages(thirds, (20, 250), "price").select("trade_date", "ticker", "ma20", "ma250")


@query(
    sql.LISTED + """ SELECT trade_date, ticker, round(CASE WHEN count(*) OVER w = 4
    THEN avg(volume) OVER w END, 6) AS volume_ma4 FROM listed
    WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""
)
def volume_ma(spark, sf_dir):
    averaged = series.moving_averages(
        adapter.listed(spark, sf_dir), (4,), "volume", places=None, prefix="volume_ma"
    )
    return averaged.select("trade_date", "ticker", F.round("volume_ma4", 6).alias("volume_ma4"))


@query(sql.VIEW + " SELECT trade_date, ticker, is_limit_up, boards FROM market")
def board_streak(spark, sf_dir):
    return adapter.view(spark, sf_dir).select("trade_date", "ticker", "is_limit_up", "boards")


# --- limit rules ------------------------------------------------------------------

_THRESHOLD = (
    "CASE WHEN is_st THEN 4.9e0 WHEN substr(ticker, 1, 3) IN ('688', '300') THEN 19.9e0"
    " ELSE 9.9e0 END"
)
_PCT_FLAGS = f"""coalesce(pct_change >= {_THRESHOLD}, false) AS is_limit_up,
    coalesce(pct_change <= -({_THRESHOLD}), false) AS is_limit_down"""


@query(sql.PANEL + f" SELECT trade_date, ticker, pct_change, is_st, {_PCT_FLAGS} FROM panel")
def limit_flags_pct(spark, sf_dir):
    flagged = market.flag_limits_by_pct(market.flag_st(adapter.panel(spark, sf_dir)))
    return flagged.select(
        "trade_date", "ticker", "pct_change", "is_st", "is_limit_up", "is_limit_down"
    )


@query(
    sql.FLAGGED + """ SELECT trade_date, ticker, pre_close, limit_pct, limit_up_price,
    limit_down_price FROM flagged"""
)
def limit_prices(spark, sf_dir):
    priced = market.add_limit_prices(market.flag_st(adapter.panel(spark, sf_dir)))
    return priced.select(
        "trade_date", "ticker", "pre_close", "limit_pct", "limit_up_price", "limit_down_price"
    )


@query(sql.FLAGGED + " SELECT trade_date, ticker, close, is_limit_up, is_limit_down FROM flagged")
def limit_flags_price(spark, sf_dir):
    flagged = market.flag_limits_by_price(market.flag_st(adapter.panel(spark, sf_dir)))
    return flagged.select("trade_date", "ticker", "close", "is_limit_up", "is_limit_down")


@query(
    sql.PANEL + """ SELECT trade_date, ticker, CASE WHEN is_st THEN 5e0 ELSE 10e0 END AS up_pct,
    CASE WHEN is_st THEN -5e0 ELSE -10e0 END AS down_pct FROM panel"""
)
def nominal_limits(spark, sf_dir):
    flagged = market.flag_st(adapter.listed(spark, sf_dir))
    return flagged.select(
        "trade_date",
        "ticker",
        limits.nominal_limit_up_pct(F.col("is_st")).alias("up_pct"),
        limits.nominal_limit_down_pct(F.col("is_st")).alias("down_pct"),
    )


@query(sql.VIEW + " SELECT trade_date, ticker, high, limit_up_price, is_broken_limit FROM market")
def broken_limit(spark, sf_dir):
    return adapter.view(spark, sf_dir).select(
        "trade_date", "ticker", "high", "limit_up_price", "is_broken_limit"
    )


@query(sql.VIEW + f" SELECT trade_date, ticker, {_OHLC}, candle_state FROM market")
def candle_state(spark, sf_dir):
    return adapter.view(spark, sf_dir).select(
        "trade_date", "ticker", "open", "high", "low", "close", "candle_state"
    )


# --- carrying forward ---------------------------------------------------------------

_DAYS = ", days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem)"


@query(
    sql.LISTED + _DAYS + """,
    steps AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM days)
    SELECT trade_date, ticker, name, open, high, low, close, volume, amount, false AS is_carried
    FROM listed
    UNION ALL
    SELECT s.next_date, p.ticker, p.name, p.open, p.high, p.low, p.close, CAST(0 AS BIGINT), 0e0, true
    FROM listed p JOIN steps s ON p.trade_date = s.trade_date
    LEFT JOIN listed c ON c.trade_date = s.next_date AND c.ticker = p.ticker
    WHERE s.next_date IS NOT NULL AND c.ticker IS NULL"""
)
def carry_missing(spark, sf_dir):
    return carry.densify_over(
        adapter.listed(spark, sf_dir), adapter.days(spark, sf_dir), max_gap=1
    )


_DENSE = _DAYS + """,
    spans AS (SELECT *, lead(trade_date) OVER (PARTITION BY ticker ORDER BY trade_date) AS next_date
              FROM {source}),
    dense AS (
      SELECT d.trade_date, s.* EXCLUDE (trade_date, volume, amount, next_date),
             CASE WHEN d.trade_date > s.trade_date THEN 0 ELSE s.volume END AS volume,
             CASE WHEN d.trade_date > s.trade_date THEN 0e0 ELSE s.amount END AS amount,
             d.trade_date > s.trade_date AS is_carried
      FROM spans s JOIN days d ON d.trade_date >= s.trade_date
       AND d.trade_date < coalesce(s.next_date, DATE '9999-12-31'))"""


@query(
    sql.LISTED + _DENSE.format(source="listed")
    + f" SELECT {_SNAPSHOT}, is_carried FROM dense"
)
def densify_history(spark, sf_dir):
    return carry.densify_over(adapter.listed(spark, sf_dir), adapter.days(spark, sf_dir))


@query(
    sql.PANEL + _DENSE.format(source="panel")
    + f""" SELECT trade_date, ticker, close, pre_close, pct_change, volume, amount, is_st,
    {_PCT_FLAGS}, is_carried FROM dense"""
)
def enrich_day(spark, sf_dir):
    dense = carry.densify_over(adapter.panel(spark, sf_dir), adapter.days(spark, sf_dir))
    return daily.derive(dense).select(
        "trade_date", "ticker", "close", "pre_close", "pct_change", "volume", "amount", "is_st",
        "is_limit_up", "is_limit_down", "is_carried",
    )
