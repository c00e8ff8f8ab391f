"""Market structure: limit prices and flags, breadth, pools, candles, journal."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import fixed_values as fixed
from ..functions import limits, numbers, tickers


def flag_st(df: DataFrame) -> DataFrame:
    return df.withColumn("is_st", tickers.is_st(F.col("name")))


def flag_limits_by_pct(df: DataFrame) -> DataFrame:
    st = F.coalesce(F.col("is_st"), F.lit(False)) if "is_st" in df.columns else F.lit(False)
    pct, ticker = F.col("pct_change"), F.col("ticker")
    return df.withColumns(
        {
            "is_limit_up": limits.pct_limit_up(pct, ticker, st),
            "is_limit_down": limits.pct_limit_down(pct, ticker, st),
        }
    )


def add_limit_prices(df: DataFrame) -> DataFrame:
    """``limit_pct``, ``limit_up_price`` and ``limit_down_price``; needs ``is_st``."""
    pre = F.col("pre_close")
    return df.withColumn(
        "limit_pct", limits.limit_rate(F.col("ticker"), F.col("is_st"))
    ).withColumns(
        {
            "limit_up_price": limits.limit_up_price(pre, F.col("limit_pct")),
            "limit_down_price": limits.limit_down_price(pre, F.col("limit_pct")),
        }
    )


def flag_limits_by_price(df: DataFrame, keep_prices: bool = False) -> DataFrame:
    df = add_limit_prices(df).withColumns(
        {
            "is_limit_up": limits.price_limit_up(F.col("close"), F.col("limit_up_price")),
            "is_limit_down": limits.price_limit_down(F.col("close"), F.col("limit_down_price")),
        }
    )
    return df if keep_prices else df.drop("limit_pct", "limit_up_price", "limit_down_price")


def flag_broken(df: DataFrame) -> DataFrame:
    """``is_broken_limit``; needs ``limit_up_price`` and ``is_limit_up``."""
    return df.withColumn(
        "is_broken_limit",
        limits.broken_limit(F.col("high"), F.col("limit_up_price"), F.col("is_limit_up")),
    )


def add_candle_state(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "candle_state",
        limits.candle_state(
            F.col("pct_change"),
            F.col("is_limit_up"),
            F.col("is_limit_down"),
            F.col("is_broken_limit"),
        ),
    )


def kpi_columns() -> list[Column]:
    """Aggregates of breadth; they need the flags and ``boards``."""
    return [
        numbers.exact_sum(F.col("amount")).alias("total_amount"),
        F.count_if(F.col("pct_change") > 0).alias("risers"),
        F.count_if(F.col("pct_change") < 0).alias("fallers"),
        F.count_if(F.col("is_limit_up")).alias("limit_ups"),
        F.count_if(F.col("is_limit_down")).alias("limit_downs"),
        F.count_if(F.col("is_broken_limit")).alias("broken_limits"),
        F.max("boards").alias("highest_board"),
    ]


def market_kpis(panel: DataFrame) -> DataFrame:
    """Breadth per day; needs the flags and ``boards``.

    One aggregation with map-side combine: what crosses the shuffle is one row
    per day and task.
    """
    return panel.groupBy("trade_date").agg(*kpi_columns())


def limit_up_count(panel: DataFrame) -> DataFrame:
    return panel.groupBy("trade_date").agg(F.count_if("is_limit_up").alias("limit_ups"))


def stock_count(panel: DataFrame) -> DataFrame:
    return panel.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_stocks"))


def limit_up_rows(panel: DataFrame, day: date | str | None = None) -> DataFrame:
    rows = panel.where("is_limit_up")
    return rows if day is None else rows.where(F.col("trade_date") == F.lit(day).cast("date"))


def themes_from_notes(notes: DataFrame) -> DataFrame:
    """Theme of a stock on a day: key of the newest theme note naming its code.

    A code is six digits that stand alone, not the start of a longer code.
    """
    named = notes.where("scope = 'theme'").select(
        "trade_date",
        F.explode(
            F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?<![\w.-])(\d{6})(?![\w-])"), F.lit(1)))
        ).alias("code"),
        "key",
        F.struct("created_at", "id").alias("_age"),
    )
    return named.groupBy("trade_date", "code").agg(F.max_by("key", "_age").alias("theme"))


def limit_up_pool(panel: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """Limit-up stocks: highest streak first, then by amount; needs ``boards``.

    ``themes`` has at most one row per (trade_date, code).
    """
    pool = limit_up_rows(panel)
    if themes is None:
        pool = pool.withColumn("theme", F.lit(None).cast("string"))
    else:
        pool = pool.withColumn("code", tickers.without_suffix(F.col("ticker"))).join(
            themes, ["trade_date", "code"], "left"
        )
    return pool.select(
        "trade_date", F.col("ticker").alias("ts_code"), "name", "boards", "amount", "theme"
    ).orderBy("trade_date", F.desc("boards"), F.desc("amount"), "ts_code")


def limit_down_pool(panel: DataFrame) -> DataFrame:
    return (
        panel.where("is_limit_down")
        .select("trade_date", F.col("ticker").alias("ts_code"), "name", "pct_change", "amount")
        .orderBy("trade_date", "pct_change", "ts_code")
    )


def big_losers(panel: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` worst changes of each day; ranks are cut before the shuffle."""
    worst = Window.partitionBy("trade_date").orderBy("pct_change", "ticker")
    return (
        panel.where(F.col("pct_change").isNotNull())
        .select("trade_date", F.col("ticker"), "name", "pct_change")
        .withColumn("loser_rank", F.row_number().over(worst))
        .where(F.col("loser_rank") <= k)
        .withColumnRenamed("ticker", "ts_code")
    )


def with_phase(kpis: DataFrame, phases: DataFrame) -> DataFrame:
    """Breadth beside the recorded phase of the day."""
    return kpis.join(phases.drop("created_at", "notes"), "trade_date", "left")


def attach_notes(panel: DataFrame, notes: DataFrame) -> DataFrame:
    """Every panel row with its stock notes: one row per note, one without notes.

    Written as an inner join plus the rows without notes instead of an outer
    join: adaptive execution can split a hot (day, stock) on either side of an
    inner join, but not the optional side of an outer one. A panel's key is never
    NULL; saying so in both branches makes them alike, so that Spark computes the
    panel once and reuses its shuffle.
    """
    panel = panel.where(F.col("trade_date").isNotNull() & F.col("ticker").isNotNull())
    stock = notes.where("scope = 'stock'").select(
        "trade_date",
        F.col("key").alias("ticker"),
        F.col("id").alias("note_id"),
        F.col("content").alias("note"),
    )
    noted = panel.join(stock, ["trade_date", "ticker"])
    bare = panel.join(
        stock.select("trade_date", "ticker").distinct(), ["trade_date", "ticker"], "left_anti"
    )
    return noted.unionByName(bare, allowMissingColumns=True)


def journal(
    notes: DataFrame,
    trade_date: date | str | None = None,
    stock: str | None = None,
    theme: str | None = None,
) -> DataFrame:
    """Review notes by day, by stock or by theme; given filters combine with AND."""
    if trade_date is not None:
        notes = notes.where(F.col("trade_date") == F.lit(trade_date).cast("date"))
    if stock is not None:
        notes = notes.where((F.col("scope") == "stock") & (F.col("key") == stock))
    if theme is not None:
        notes = notes.where((F.col("scope") == "theme") & (F.col("key") == theme))
    return notes.orderBy("trade_date", "id")


def daily_bars(panel: DataFrame) -> DataFrame:
    """The panel under its older column names."""
    view = flag_broken(add_limit_prices(panel)).withColumnsRenamed(fixed.DAILY_BARS_MAPPING)
    return view.select(
        "ts_code", "trade_date", "open", "high", "low", "close", "pre_close", "pct_chg", "vol",
        "amount", "is_limit_up", "is_limit_down", "is_broken_limit",
    )
