"""Breadth, pools, phase, notes and journal queries."""

from __future__ import annotations

from ..operators import market
from ..plans import review
from ..sources.store import between_days
from . import adapter, sql
from .registry import query

_KPIS = """SELECT trade_date, CAST(sum(amount_cents) AS DOUBLE) / 100e0 AS total_amount,
      count(*) FILTER (pct_change > 0) AS risers, count(*) FILTER (pct_change < 0) AS fallers,
      count(*) FILTER (is_limit_up) AS limit_ups, count(*) FILTER (is_limit_down) AS limit_downs,
      count(*) FILTER (is_broken_limit) AS broken_limits, max(boards) AS highest_board
    FROM market GROUP BY trade_date"""


@query(sql.VIEW + " " + _KPIS)
def market_kpis(spark, sf_dir):
    return market.market_kpis(adapter.view(spark, sf_dir))


@query(sql.FLAGGED + " SELECT trade_date, count(*) FILTER (is_limit_up) AS limit_ups FROM flagged GROUP BY 1")
def limit_up_count(spark, sf_dir):
    return market.limit_up_count(
        market.flag_limits_by_price(market.flag_st(adapter.panel(spark, sf_dir)))
    )


@query(sql.LISTED + " SELECT trade_date, count(*) AS n_stocks FROM listed GROUP BY 1")
def stock_count(spark, sf_dir):
    return market.stock_count(adapter.listed(spark, sf_dir))


@query(sql.FLAGGED + " SELECT trade_date, ticker, close FROM flagged WHERE is_limit_up")
def limit_up_rows(spark, sf_dir):
    flagged = market.flag_limits_by_price(market.flag_st(adapter.panel(spark, sf_dir)))
    return market.limit_up_rows(flagged).select("trade_date", "ticker", "close")


@query(
    sql.VIEW + ", " + sql.NOTES + """, themes AS (
      SELECT trade_date, stock AS code, arg_max(key, (created_at, id)) AS theme
      FROM notes WHERE scope = 'theme' GROUP BY trade_date, stock)
    SELECT m.trade_date, m.ticker AS ts_code, m.name, m.boards, m.amount, t.theme
    FROM market m LEFT JOIN themes t
      ON t.trade_date = m.trade_date AND t.code = regexp_replace(m.ticker, '\\.(SH|SZ|BJ)$', '')
    WHERE m.is_limit_up"""
)
def limit_up_pool(spark, sf_dir):
    themes = market.themes_from_notes(adapter.notes(spark, sf_dir))
    return market.limit_up_pool(adapter.view(spark, sf_dir), themes)


@query(
    sql.VIEW + """ SELECT trade_date, ticker AS ts_code, name, pct_change, amount FROM market
    WHERE is_limit_down"""
)
def limit_down_pool(spark, sf_dir):
    return market.limit_down_pool(adapter.view(spark, sf_dir))


@query(
    sql.PANEL + """, ranked AS (
      SELECT trade_date, ticker AS ts_code, name, pct_change, CAST(row_number() OVER (
        PARTITION BY trade_date ORDER BY pct_change, ticker) AS INTEGER) AS loser_rank
      FROM panel WHERE pct_change IS NOT NULL)
    SELECT * FROM ranked WHERE loser_rank <= 3"""
)
def big_losers(spark, sf_dir):
    return market.big_losers(adapter.panel(spark, sf_dir), k=3)




@query(
    sql.VIEW + ", " + sql.PHASES + ", kpis AS (" + _KPIS + """)
    SELECT k.*, p.phase, p."M1_core", p."M2_front", p."M3_identifiable", p."V_triggered"
    FROM kpis k LEFT JOIN phases p ON p.trade_date = k.trade_date"""
)
def kpi_with_phase(spark, sf_dir):
    kpis = market.market_kpis(adapter.view(spark, sf_dir))
    return market.with_phase(kpis, adapter.phases(spark, sf_dir))


@query(
    sql.BARS + ", " + sql.PHASES + """ SELECT trade_date, phase, "M1_core", "M2_front",
      "M3_identifiable", "V_triggered" FROM phases
    WHERE trade_date >= DATE '1997-01-01' AND trade_date <= DATE '1998-12-31'"""
)
def phase_query(spark, sf_dir):
    phases = adapter.phases(spark, sf_dir).drop("notes", "created_at")
    return between_days(phases, start_date="1997-01-01", end_date="1998-12-31")


@query(
    sql.VIEW + ", " + sql.NOTES + """
    SELECT m.trade_date, m.ticker, m.close, m.candle_state, n.id AS note_id, n.content AS note
    FROM market m LEFT JOIN notes n
      ON n.scope = 'stock' AND n.trade_date = m.trade_date AND n.key = m.ticker"""
)
def stock_with_notes(spark, sf_dir):
    view = adapter.view(spark, sf_dir).select("trade_date", "ticker", "close", "candle_state")
    return market.attach_notes(view, adapter.notes(spark, sf_dir))


@query(
    sql.VIEW + """, averaged AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN
        CAST(sum(CAST(round(close * 10000) AS BIGINT)) OVER w AS DOUBLE) / 50000e0 END AS ma5
      FROM market
      WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT trade_date, ticker, open, high, low, close, candle_state, ma5 FROM averaged
    WHERE trade_date >= DATE '1998-01-01'"""
)
def stock_view(spark, sf_dir):
    shown = review.stock_view(adapter.view(spark, sf_dir), lengths=(5,), start="1998-01-01", places=4)
    return shown.select(
        "trade_date", "ticker", "open", "high", "low", "close", "candle_state", "ma5"
    )


@query("WITH " + sql.NOTES + " SELECT id, trade_date, scope, key, content FROM notes WHERE trade_date = DATE '1995-05-20'")
def journal_by_date(spark, sf_dir):
    return market.journal(adapter.notes(spark, sf_dir), trade_date="1995-05-20").drop("created_at")


@query("WITH " + sql.NOTES + " SELECT id, trade_date, scope, key, content FROM notes WHERE scope = 'stock' AND key = '600008.SH'")
def journal_by_stock(spark, sf_dir):
    return market.journal(adapter.notes(spark, sf_dir), stock="600008.SH").drop("created_at")


@query("WITH " + sql.NOTES + " SELECT id, trade_date, scope, key, content FROM notes WHERE scope = 'theme' AND key = 'signup'")
def journal_by_theme(spark, sf_dir):
    return market.journal(adapter.notes(spark, sf_dir), theme="signup").drop("created_at")


@query(
    sql.VIEW + """ SELECT ticker AS ts_code, trade_date, open, high, low, close, pre_close,
      pct_change AS pct_chg, volume AS vol, amount, is_limit_up, is_limit_down, is_broken_limit
    FROM market"""
)
def daily_bars(spark, sf_dir):
    flagged = market.flag_limits_by_price(market.flag_st(adapter.panel(spark, sf_dir)))
    return market.daily_bars(flagged)


