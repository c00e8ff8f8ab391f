"""Market tables derived from the driver's tables.

A supplier is a stock, a ship date a trading day; prices are built in whole
cents around a base per stock so that limits are hit now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tickers
from ..operators import series
from ..plans import review
from ..session import RELEASED, settings, shared_dir

CODE_PREFIXES = ("600", "688", "000", "300", "430", "830", "920", "601")
#: the rule for this market's tickers: ``stock_code`` gives a class part past 100,000 stocks
TICKER_FORM = tickers.is_class_ticker
BAR_COLUMNS = ("open", "high", "low", "close", "volume", "amount")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stock_code(k: Column, unknown: bool = False) -> Column:
    """Six digits, distinct below 100,000 stocks; past those a class part keeps them so.

    Stocks from 1,000 on take free numbers of the 4 and 8 blocks, and of 603 and 605 where
    others have those. With ``unknown`` every fiftieth has a code that no exchange rule knows.
    """
    small = F.lit(CODE_PREFIXES[-1])
    for place in range(len(CODE_PREFIXES) - 2, -1, -1):
        small = F.when(k % 8 == place, CODE_PREFIXES[place]).otherwise(small)
    rest, even = F.lpad((k % 1000).cast("string"), 3, "0"), k % 2 == 0
    code = (
        F.when(k < 1000, F.concat(small, rest))
        .when(k >= 100000, F.concat(small, rest, F.lit("-"), F.floor(k / 1000).cast("string")))
        .when(k.between(30000, 30999), F.concat(F.when(even, "605").otherwise("603"), rest))
        .otherwise(F.concat(F.when(even, "4").otherwise("8"), F.lpad(k.cast("string"), 5, "0")))
    )
    return F.when(k % 50 == 49, F.concat(F.lit("510"), rest)).otherwise(code) if unknown else code


def bars(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, unknown: bool = False
) -> DataFrame:
    """One row per stock and day. ``lines`` limits the line items used; ``unknown`` as in
    ``stock_code``.

    Lines go to their stock's ticker once, and bars, names and series of a ticker are made where
    they lie. Most bars have one line, so sums before that shuffle would save no rows and send
    wider ones. Lines are aggregated before the names are joined on, so the join sees one row
    per bar.
    """
    lines = read(spark, sf_dir, "lineitem") if lines is None else lines
    k = F.col("l_suppkey")

    def ticker(number: Column) -> Column:
        return tickers.suffix_daily(stock_code(number, unknown))

    traded = lines.select(
        ticker(k).alias("ticker"),
        k.alias("k"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        ((k + 10) * ((F.col("l_orderkey") + F.col("l_partkey") * 7) % 33 + 84)).alias("px"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias(
            "ord"
        ),
    )
    daily = traded.repartition("ticker").groupBy("ticker", "trade_date", "k").agg(
        F.min_by("px", "ord").alias("o"),
        F.max("px").alias("h"),
        F.min("px").alias("lo"),
        F.max_by("px", "ord").alias("c"),
        F.sum("qty").alias("volume"),
        F.sum(F.col("px") * F.col("qty")).alias("amount_cents"),
    )
    own = F.col("s_suppkey")
    names = read(spark, sf_dir, "supplier").select(ticker(own).alias("ticker"), own.alias("own"), "s_name")
    label = (
        F.when(F.col("k") % 10 == 0, "*ST ").when(F.col("k") % 10 == 5, "st ").otherwise("")
    )
    same = daily["ticker"] == names["ticker"]
    if unknown:  # stocks share codes there
        same = same & (F.col("k") == F.col("own"))
    return daily.join(names, same, "left").select(
        "trade_date",
        "k",
        daily["ticker"],
        stock_code(F.col("k"), unknown).alias("code"),
        F.concat(label, "s_name").alias("name"),
        (F.col("o") / 100).alias("open"),
        (F.col("h") / 100).alias("high"),
        (F.col("lo") / 100).alias("low"),
        (F.col("c") / 100).alias("close"),
        F.col("c").alias("close_cents"),
        "volume",
        (F.col("amount_cents") / 100).alias("amount"),
        "amount_cents",
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days: the ship dates, read as a single column."""
    dates = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date"))
    return dates.toDF("trade_date").where("trade_date is not null").distinct()


def listed(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Bars under suffixed tickers."""
    return bars(spark, sf_dir, lines).select(
        "trade_date",
        "ticker",
        "name",
        *BAR_COLUMNS,
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed bars with previous close and percent change."""
    return series.derive_changes(listed(spark, sf_dir), drop_first=False)


def kept(rows: DataFrame) -> DataFrame:
    """Rows that a query takes several times, derived once and kept in the shared folder."""
    path = shared_dir(rows.sparkSession, "kept")
    with settings(rows.sparkSession, **RELEASED):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.market_view(panel(spark, sf_dir))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as text, with junk, unknown codes, three date forms and repeated rows."""
    known = bars(spark, sf_dir, unknown=True)
    copies = F.when(F.col("k") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    day = F.col("trade_date").cast("string")
    k, volume, code = F.col("k"), F.col("volume"), F.col("code")

    def by_remainder(n: int, values: list) -> Column:
        out = F.lit(values[-1]) if isinstance(values[-1], str) else values[-1]
        for place in range(n - 2, -1, -1):
            out = F.when(k % n == place, values[place]).otherwise(out)
        return out

    return known.withColumn("n", F.explode(copies)).select(
        (k * 10 + F.col("n")).alias("seq"),
        by_remainder(3, [day, F.replace(day, F.lit("-"), F.lit("")), F.replace(day, F.lit("-"), F.lit("/"))])
        .alias("trade_date_text"),
        F.when(code.startswith("000"), code.try_cast("bigint").cast("string"))
        .otherwise(code)
        .alias("code_text"),
        F.when(F.col("n") == 2, F.concat("name", F.lit(" rev"))).otherwise(F.col("name")).alias("name_text"),
        F.when(volume % 17 == 0, "-").otherwise(F.col("close").cast("string")).alias("close_text"),
        F.when(volume % 13 == 0, "").otherwise(volume.cast("string")).alias("volume_text"),
        by_remainder(4, ["yes", "0", "否", "maybe"]).alias("flag_text"),
        by_remainder(3, ["tushare", "sina", "em"]).alias("source"),
        "trade_date",
        "code",
        "n",
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review notes over all stocks and days. Stock notes are keyed by ticker, theme notes
    name a code."""
    events = read(spark, sf_dir, "events")
    scope = F.col("event_id") % 3
    stock = stock_code(F.col("user_id") % read(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar())
    shipped = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    first = shipped.agg(F.min("day")).scalar()
    span = shipped.agg(F.date_diff(F.max("day"), F.min("day")) + 1).scalar()
    return events.select(
        F.col("event_id").cast("int").alias("id"),
        F.date_add(first, (F.floor(F.col("event_id") / 3) % span).cast("int")).alias("trade_date"),
        F.when(scope == 0, "market").when(scope == 1, "theme").otherwise("stock").alias("scope"),
        F.when(scope == 0, "all")
        .when(scope == 1, F.col("event_type"))
        .otherwise(tickers.suffix_daily(stock))
        .alias("key"),
        F.when(scope == 1, F.concat_ws(" ", F.lit("watch"), stock, F.col("props")))
        .otherwise(F.col("props"))
        .alias("content"),
        F.col("ts").alias("created_at"),
    )


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    counted = bars(spark, sf_dir).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "trade_date",
        F.when(n % 3 == 0, "rise").when(n % 3 == 1, "ebb").otherwise("chaos").alias("phase"),
        (n % 2 == 0).alias("M1_core"),
        (n % 3 == 0).alias("M2_front"),
        (n % 5 == 0).alias("M3_identifiable"),
        (n % 7 == 0).alias("V_triggered"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("trade_id"),
        (F.col("o_custkey") % 100).cast("string").alias("ticker"),
        F.col("o_orderdate").cast("date").alias("entry_date"),
        F.col("o_totalprice").alias("entry_price"),
        F.col("o_orderpriority").alias("path_type"),
        F.col("o_orderstatus").alias("notes"),
    )
