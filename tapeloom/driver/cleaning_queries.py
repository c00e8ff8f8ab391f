"""Mapping, conversion, text-rule, cleaning and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import DAILY_MARKET_SNAPSHOT, build_custom_mapping, layout_of
from ..functions import dates, numbers, tickers
from ..operators import keys, quality
from ..operators.shaping import apply_mapping as map_headers
from ..operators.shaping import conform, rename_headers, stamp
from ..plans import daily
from ..session import shared_dir
from ..sources import raw_files
from . import adapter, sql
from .registry import query

_RAW_TO_SINA = {
    "code_text": "代码", "name_text": "名称", "close_text": "最新价", "volume_text": "成交量"
}
_RAW_TO_TUSHARE = {"code_text": "ts_code", "close_text": "close", "volume_text": "vol"}


def _delivered(spark, sf_dir):
    """Raw rows under contract names, still text."""
    return rename_headers(
        adapter.raw(spark, sf_dir).drop("trade_date"),
        {
            "trade_date_text": "trade_date", "code_text": "ticker", "name_text": "name",
            "close_text": "close", "volume_text": "volume", "flag_text": "is_st",
        },
    )


# --- mapping ----------------------------------------------------------------------


@query(
    sql.RAW + """ SELECT seq, trade_date, code_text AS ticker, name_text AS name,
    close_text AS close, volume_text AS volume, flag_text FROM raw"""
)
def apply_mapping(spark, sf_dir):
    raw = adapter.raw(spark, sf_dir).select("seq", "trade_date", "flag_text", *_RAW_TO_SINA)
    return map_headers(rename_headers(raw, _RAW_TO_SINA), "sina_realtime")


@query(
    sql.RAW + """ SELECT trade_date, code_text AS ticker, close_text AS close,
    volume_text AS volume FROM raw"""
)
def apply_mapping_drop_extra(spark, sf_dir):
    raw = rename_headers(adapter.raw(spark, sf_dir), _RAW_TO_TUSHARE)
    return map_headers(raw, "tushare_daily", drop_extra=True)


@query(
    sql.RAW + """ SELECT seq, code_text AS ticker, trade_date_text AS trade_date FROM raw"""
)
def custom_mapping(spark, sf_dir):
    mapping = build_custom_mapping({"股票代码": "ticker", "交易日期": "trade_date"})
    raw = adapter.raw(spark, sf_dir).select(
        "seq", F.col("code_text").alias("股票代码"), F.col("trade_date_text").alias("交易日期")
    )
    return rename_headers(raw, mapping)


@query(
    sql.LISTED + """ SELECT trade_date, ticker, name, open, high, low, close,
    CAST(NULL AS DOUBLE) AS pct_change, CAST(NULL AS DOUBLE) AS pre_close, volume, amount,
    CAST(NULL AS DOUBLE) AS turnover, CAST(NULL AS DOUBLE) AS market_cap,
    CAST(NULL AS DOUBLE) AS float_cap, CAST(NULL AS BOOLEAN) AS is_st,
    CAST(NULL AS BOOLEAN) AS is_limit_up, CAST(NULL AS BOOLEAN) AS is_limit_down FROM listed"""
)
def conform_contract(spark, sf_dir):
    return conform(adapter.listed(spark, sf_dir), DAILY_MARKET_SNAPSHOT).drop("created_at")


# --- conversions --------------------------------------------------------------------

_CLOSE = "TRY_CAST(close_text AS DOUBLE)"
_VOLUME = "TRY_CAST(nullif(volume_text, '') AS DOUBLE)"
_FLAG = (
    "CASE WHEN flag_text IN ('1','true','True','TRUE','yes','Yes','YES','是') THEN true"
    " WHEN flag_text IN ('0','false','False','FALSE','no','No','NO','否') THEN false END"
)
_DATE = """CASE WHEN regexp_full_match(trade_date_text, '\\d{8}')
      THEN CAST(TRY_STRPTIME(trade_date_text, '%Y%m%d') AS DATE)
      ELSE CAST(TRY_STRPTIME(replace(trade_date_text, '/', '-'), '%Y-%m-%d') AS DATE) END"""


@query(sql.RAW + f" SELECT seq, trade_date, {_CLOSE} AS close, {_VOLUME} AS volume FROM raw")
def coerce_numeric(spark, sf_dir):
    delivered = _delivered(spark, sf_dir).withColumn("day", dates.parse_date(F.col("trade_date")))
    coerced = quality.convert_numeric(delivered, ["close", "volume"])
    return coerced.select("seq", F.col("day").alias("trade_date"), "close", "volume")


@query(sql.RAW + f" SELECT seq, trade_date, {_FLAG} AS is_st FROM raw")
def coerce_boolean(spark, sf_dir):
    raw = adapter.raw(spark, sf_dir).withColumnRenamed("flag_text", "is_st")
    return quality.convert_boolean(raw).select("seq", "trade_date", "is_st")


@query(
    sql.RAW + """ SELECT seq, trade_date, CASE WHEN flag_text IN ('yes', 'maybe') THEN true
    WHEN flag_text = '否' THEN false END AS is_st FROM raw"""
)
def coerce_boolean_words(spark, sf_dir):
    raw = adapter.raw(spark, sf_dir).withColumnRenamed("flag_text", "is_st")
    return quality.convert_boolean(
        raw, true_words=("yes", "maybe"), false_words=("否",)
    ).select("seq", "trade_date", "is_st")


@query(sql.RAW + f" SELECT seq, trade_date_text, {_DATE} AS trade_date FROM raw")
def coerce_date(spark, sf_dir):
    raw = adapter.raw(spark, sf_dir).select(
        "seq", "trade_date_text", F.col("trade_date_text").alias("trade_date")
    )
    return quality.convert_date(raw)


@query(
    sql.RAW + f""" SELECT seq, {_DATE} AS trade_date, code_text AS ticker, name_text AS name,
    {_CLOSE} AS close, {_VOLUME} AS volume, {_FLAG} AS is_st, source FROM raw"""
)
def canonicalize(spark, sf_dir):
    return quality.canonicalize(_delivered(spark, sf_dir)).drop("code", "n")


# --- text and date rules ---------------------------------------------------------------

_PADDED = "CASE WHEN length(trim(code_text)) < 6 THEN lpad(trim(code_text), 6, '0') ELSE trim(code_text) END"
_EXCHANGE = f"""CASE
   WHEN substr({_PADDED}, 1, 2) IN ('60','68','50','51','52','53','54','55','56','57','58','59') THEN 'SH'
   WHEN substr({_PADDED}, 1, 2) IN ('00','30','12','15','16','17','18','19') THEN 'SZ'
   WHEN substr({_PADDED}, 1, 2) IN ('43','83','87','88','92') THEN 'BJ' ELSE 'UNKNOWN' END"""
_SUFFIXED = sql.suffixed("(" + _PADDED + ")")


def _codes(spark, sf_dir, **columns):
    raw = adapter.raw(spark, sf_dir).select("seq", "trade_date", "code_text", "name_text")
    return raw.select("seq", "trade_date", *[c.alias(n) for n, c in columns.items()])


@query(sql.RAW + f" SELECT seq, trade_date, {_PADDED} AS ticker FROM raw")
def format_ticker(spark, sf_dir):
    return _codes(spark, sf_dir, ticker=tickers.format_ticker(F.col("code_text")))


@query(sql.RAW + f" SELECT seq, trade_date, {_EXCHANGE} AS exchange FROM raw")
def exchange(spark, sf_dir):
    return _codes(spark, sf_dir, exchange=tickers.exchange(F.col("code_text")))


@query(
    sql.RAW + f""" SELECT exchange, count(*) AS n_rows FROM
    (SELECT {_EXCHANGE} AS exchange FROM raw) WHERE exchange IN ('SH', 'BJ') GROUP BY exchange"""
)
def exchange_filter(spark, sf_dir):
    code = F.col("code_text")
    kept = adapter.raw(spark, sf_dir).where(tickers.is_sh_ticker(code) | tickers.is_bj_ticker(code))
    return kept.groupBy(tickers.exchange(code).alias("exchange")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(sql.RAW + f" SELECT seq, trade_date, {_SUFFIXED} AS ticker FROM raw")
def suffix_daily(spark, sf_dir):
    return _codes(spark, sf_dir, ticker=tickers.suffix_daily(F.col("code_text")))


@query(
    sql.RAW + f""" SELECT seq, trade_date, {_SUFFIXED} AS ticker, {_SUFFIXED} AS again FROM raw"""
)
def suffix_history(spark, sf_dir):
    once = tickers.suffix_history(F.concat(F.lit(" "), F.col("code_text"), F.lit(" ")))
    return _codes(spark, sf_dir, ticker=once).withColumn(
        "again", tickers.suffix_history(F.col("ticker"))
    )


@query(
    sql.RAW + """ SELECT seq, trade_date, coalesce(upper(name_text) LIKE '%ST%', false) AS is_st
    FROM raw"""
)
def is_st(spark, sf_dir):
    return _codes(spark, sf_dir, is_st=tickers.is_st(F.col("name_text")))


@query(sql.RAW + " SELECT seq, trade_date_text, strftime(trade_date, '%Y/%m/%d') AS shown FROM raw")
def format_date(spark, sf_dir):
    shown = dates.format_date(F.col("trade_date_text"), to_format="%Y/%m/%d")
    return adapter.raw(spark, sf_dir).select("seq", "trade_date_text", shown.alias("shown"))


# --- cleaning -------------------------------------------------------------------------------

_CLEANED = sql.RAW + f""", typed AS (
      SELECT {_DATE} AS trade_date, code_text AS ticker, name_text AS name, {_CLOSE} AS close,
             {_VOLUME} AS volume, seq, source FROM raw
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY trade_date, ticker ORDER BY seq DESC) AS rn FROM typed
    ), cleaned AS (
      SELECT trade_date, ticker, CASE WHEN source <> 'tushare' THEN name END AS name, close,
             CAST(volume AS BIGINT) AS volume, source FROM ranked WHERE rn = 1
    )"""
_CLEAN_COLUMNS = ["trade_date", "ticker", "name", "close", "volume"]


def landed_sources(spark, sf_dir):
    """Raw rows per source code, each under its own headers."""
    raw = adapter.raw(spark, sf_dir)
    out = {}
    for code, renames in (("tushare", _RAW_TO_TUSHARE), ("sina", _RAW_TO_SINA), ("em", _RAW_TO_SINA)):
        text = "yyyyMMdd" if code == "tushare" else "yyyy-MM-dd"
        rows = raw.where(F.col("source") == code).withColumn("trade_date", F.date_format("trade_date", text))
        out[code] = rename_headers(rows, renames)
    return out


@query(
    sql.RAW + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY trade_date, code
      ORDER BY seq DESC) AS rn FROM raw)
    SELECT trade_date, code AS ticker, name_text AS name, seq FROM ranked WHERE rn = 1"""
)
def dedupe_keep_last(spark, sf_dir):
    raw = adapter.raw(spark, sf_dir).select(
        "trade_date", F.col("code").alias("ticker"), F.col("name_text").alias("name"), "seq"
    )
    return keys.keep_last(raw, ["seq"])


@query(_CLEANED + " SELECT trade_date, ticker, name, close, volume, source FROM cleaned")
def clean_daily_snapshot(spark, sf_dir):
    out = None
    for code, rows in landed_sources(spark, sf_dir).items():
        cleaned = daily.clean_snapshot(rows, layout_of(code), ["seq"])
        part = stamp(cleaned.select(*_CLEAN_COLUMNS), source=code)
        out = part if out is None else out.unionByName(part)
    return out


_BEST = """, best AS (
      SELECT trade_date, min(CASE source WHEN 'tushare' THEN 0 WHEN 'sina' THEN 1 ELSE 2 END) AS rank
      FROM cleaned GROUP BY trade_date)"""


@query(
    _CLEANED + _BEST + """ SELECT c.trade_date, ticker, name, close, volume FROM cleaned c
    JOIN best b ON b.trade_date = c.trade_date
     AND b.rank = CASE source WHEN 'tushare' THEN 0 WHEN 'sina' THEN 1 ELSE 2 END"""
)
def source_priority(spark, sf_dir):
    return daily.clean_sources(landed_sources(spark, sf_dir), ["seq"]).select(*_CLEAN_COLUMNS)


@query(
    _CLEANED + """, days AS (SELECT DISTINCT trade_date, source, CASE source WHEN 'tushare' THEN 0 WHEN 'sina' THEN 1
        ELSE 2 END AS rank FROM cleaned WHERE source <> 'tushare' OR day(trade_date) % 3 <> 0),
    best AS (SELECT trade_date, min(rank) AS rank FROM days GROUP BY trade_date)
    SELECT c.trade_date, ticker, name, close, volume FROM cleaned c
    JOIN days d ON d.trade_date = c.trade_date AND d.source = c.source
    JOIN best b ON b.trade_date = c.trade_date AND b.rank = d.rank"""
)
def source_choice(spark, sf_dir):
    """Three sources landed by day, the best one without some days; only the best of each
    day is read."""
    path = shared_dir(spark, "choice")
    for code, rows in landed_sources(spark, sf_dir).items():
        if code == "tushare":
            rows = rows.where(F.substring("trade_date", 7, 2).cast("int") % 3 != 0)
        raw_files.write_raw(stamp(rows, source=code), path)
    seq = F.col("seq").cast("bigint")
    return daily.clean_landing(spark, path, [seq]).select(*_CLEAN_COLUMNS)


# --- data quality --------------------------------------------------------------------------------


@query(
    sql.RAW + """ SELECT trade_date, code AS ticker, count(*) AS n_rows FROM raw
    GROUP BY trade_date, code HAVING count(*) > 1"""
)
def duplicate_keys(spark, sf_dir):
    raw = adapter.raw(spark, sf_dir).withColumnRenamed("code", "ticker")
    return keys.duplicate_keys(raw)


def _suffixed_rows(spark, sf_dir):
    return adapter.raw(spark, sf_dir).select(
        "seq", "trade_date", tickers.suffix_daily(F.col("code_text")).alias("ticker")
    )


@query(
    sql.RAW + f""" SELECT seq, trade_date, ticker FROM
    (SELECT seq, trade_date, {_SUFFIXED} AS ticker FROM raw)
    WHERE NOT regexp_full_match(ticker, '\\d{{6}}\\.(SH|SZ|BJ)')"""
)
def ticker_quarantine(spark, sf_dir):
    return quality.split_valid_tickers(_suffixed_rows(spark, sf_dir))[1]


@query(
    sql.RAW + """ SELECT seq, trade_date, code_text,
    coalesce(regexp_full_match(code_text, '\\d{6}'), false) AS is_bare FROM raw"""
)
def bare_ticker(spark, sf_dir):
    bare = tickers.is_bare_ticker(F.col("code_text"))
    return adapter.raw(spark, sf_dir).select("seq", "trade_date", "code_text", bare.alias("is_bare"))


@query(
    sql.RAW + f""" SELECT seq, trade_date, ticker FROM
    (SELECT seq, trade_date, {_SUFFIXED} AS ticker FROM raw)
    WHERE regexp_full_match(ticker, '\\d{{6}}\\.(SH|SZ|BJ)')"""
)
def ticker_valid(spark, sf_dir):
    return quality.split_valid_tickers(_suffixed_rows(spark, sf_dir))[0]


def _order_files(spark, sf_dir):
    """Orders as files: named for one day of their month, filled with others too."""
    orders = adapter.read(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    named = F.concat(
        F.date_format(F.when(F.col("o_orderstatus") == "F", F.trunc(day, "month")).otherwise(day), "yyyy-MM-dd"),
        F.lit("_Astock_"), F.lower("o_orderstatus"), F.lit(".csv"),
    )
    return orders.select(named.alias("file_name"), day.alias("trade_date")).withColumn(
        "file_date", raw_files.file_date(F.col("file_name"))
    )


_FILES = """WITH named AS (
      SELECT CAST(o_orderdate AS DATE) AS trade_date,
             CASE WHEN o_orderstatus = 'F' THEN CAST(date_trunc('month', o_orderdate) AS DATE)
                  ELSE CAST(o_orderdate AS DATE) END AS file_date, lower(o_orderstatus) AS part
      FROM orders), files AS (
      SELECT strftime(file_date, '%Y-%m-%d') || '_Astock_' || part || '.csv' AS file_name, * FROM named)"""


@query(
    _FILES + """ SELECT file_name, file_date, count(DISTINCT trade_date) AS n_dates,
      min(trade_date) AS min_date, max(trade_date) AS max_date,
      count(DISTINCT trade_date) = 1 AND min(trade_date) = file_date AS agrees
    FROM files GROUP BY file_name, file_date"""
)
def file_date_check(spark, sf_dir):
    return quality.file_dates(_order_files(spark, sf_dir)).drop("n_undated")


@query(
    _FILES + """ SELECT file_name, count(*) AS n_rows FROM files GROUP BY file_name
    UNION ALL SELECT NULL, count(*) FROM files"""
)
def load_report(spark, sf_dir):
    return raw_files.load_report(_order_files(spark, sf_dir))


@query(
    sql.RAW + f""", counted AS (
      SELECT count(*) FILTER (trim(close_text) <> '' AND {_CLOSE} IS NULL) AS c,
             count(*) FILTER (trim(volume_text) <> '' AND {_VOLUME} IS NULL) AS v,
             count(*) FILTER (trim(flag_text) <> '' AND {_FLAG} IS NULL) AS f,
             count(*) FILTER (trim(trade_date_text) <> '' AND {_DATE} IS NULL) AS d FROM raw)
    SELECT 'close' AS column_name, c AS n_failed FROM counted
    UNION ALL SELECT 'volume', v FROM counted UNION ALL SELECT 'is_st', f FROM counted
    UNION ALL SELECT 'trade_date', d FROM counted"""
)
def conversion_failures(spark, sf_dir):
    return quality.conversion_failures(_delivered(spark, sf_dir))


@query(
    sql.RAW + f""", s AS (SELECT trade_date, {_SUFFIXED} AS ticker FROM raw)
    SELECT 'ticker_format' AS rule, CAST(NULL AS VARCHAR) AS file, trade_date, ticker, ticker AS value
    FROM s WHERE NOT regexp_full_match(ticker, '\\d{{6}}\\.(SH|SZ|BJ)')
    UNION ALL
    SELECT 'repeated_key', NULL, trade_date, ticker, CAST(count(*) AS VARCHAR) FROM s
    GROUP BY trade_date, ticker HAVING count(*) > 1"""
)
def quality_report(spark, sf_dir):
    return quality.quality_report(_suffixed_rows(spark, sf_dir))


@query(sql.RAW + " SELECT DISTINCT code AS ticker FROM raw EXCEPT SELECT ticker FROM (" + "SELECT " + _SUFFIXED + " AS ticker FROM raw)")
def missing_tickers(spark, sf_dir):
    bare = adapter.raw(spark, sf_dir).select(F.col("code").alias("ticker"))
    return keys.missing_tickers(bare, _suffixed_rows(spark, sf_dir))


