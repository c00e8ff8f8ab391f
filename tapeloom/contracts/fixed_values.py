"""Names, prefixes, word lists, thresholds and header mappings.

Everything here is data that must equal the published contract for results to
be right. It is stated once, in natural order, and used everywhere else.
"""

# --- fixed values: field groups ---------------------------------------------

OHLCV_FIELDS = ("open", "high", "low", "close", "volume")

PRICE_FIELDS = (
    "open", "high", "low", "close", "pre_close",
    "entry_price", "exit_price", "half_sell_price",
)

NUMERIC_FIELDS = (
    "open", "high", "low", "close", "volume", "amount", "pct_change", "turnover",
    "market_cap", "float_cap", "pre_close", "entry_price", "exit_price",
    "half_sell_price", "half_sell_trigger", "position_pct",
)

BOOLEAN_FIELDS = (
    "is_st", "is_limit_up", "is_limit_down",
    "M1_core", "M2_front", "M3_identifiable", "V_triggered",
)

DATE_FIELDS = ("trade_date", "entry_date", "exit_date", "half_sell_date")

STRING_FIELDS = ("ticker", "trade_id", "name")

IDENTIFIER_FIELDS = ("ticker", "trade_id")

# --- fixed values: conventions ----------------------------------------------

DATE_FORMAT = "%Y-%m-%d"
DATE_FORMAT_COMPACT = "%Y%m%d"
DATE_FORMAT_SLASH = "%Y/%m/%d"
DATETIME_FORMAT = "%Y-%m-%d %H:%M:%S"

TICKER_LENGTH = 6
TICKER_PATTERN = r"^\d{6}$"
SUFFIXED_TICKER_PATTERN = r"^\d{6}\.(SH|SZ|BJ)$"
#: a market with more stocks than six digits tell apart: a class part may follow them
CLASS_TICKER_PATTERN = r"^\d{6}(-[1-9]\d*)?\.(SH|SZ|BJ)$"

DECIMAL_PLACES = 4
VOLUME_UNIT = "股"
AMOUNT_UNIT = "元"
MARKET_CAP_UNIT = "元"

MARKET_ZONE = "Asia/Shanghai"
MARKET_CLOSE = "15:00"

# two-digit exchange prefixes of the contract
SH_PREFIXES = ("60", "68", "50", "51", "52", "53", "54", "55", "56", "57", "58", "59")
SZ_PREFIXES = ("00", "30", "12", "15", "16", "17", "18", "19")
BJ_PREFIXES = ("43", "83", "87", "88", "92")

# prefixes by which the file loaders choose a suffix
LOADER_SH_PREFIXES = ("600", "601", "603", "605", "688", "689")
LOADER_SZ_PREFIXES = ("000", "001", "002", "003", "300", "301", "302")
LOADER_BJ_PREFIXES = ("4", "8", "920")

TRUE_WORDS = ("1", "true", "True", "TRUE", "yes", "Yes", "YES", "是")
FALSE_WORDS = ("0", "false", "False", "FALSE", "no", "No", "NO", "否")

NOTE_SCOPES = ("market", "theme", "stock")

# --- fixed values: price limits ---------------------------------------------

LIMIT_UP_PCT, LIMIT_UP_ST_PCT = 10.0, 5.0
LIMIT_DOWN_PCT, LIMIT_DOWN_ST_PCT = -10.0, -5.0

# limit rate by board, in percent
MAIN_BOARD_RATE, GROWTH_BOARD_RATE, BJ_BOARD_RATE, ST_RATE = 10.0, 20.0, 30.0, 5.0
GROWTH_BOARD_PREFIXES = ("300", "301", "302", "688", "689")
BJ_BOARD_PREFIXES = ("4", "8", "920")
MAIN_BOARD_PREFIXES = ("600", "601", "603", "605", "000", "001", "002", "003")
PRICE_TOLERANCE = 0.001

# limit flags by percent change
PLAIN_THRESHOLD, ST_THRESHOLD, GROWTH_THRESHOLD = 9.9, 4.9, 19.9
GROWTH_THRESHOLD_PREFIXES = ("688", "300")

# --- fixed values: moving-average lengths -----------------------------------

MOVING_AVERAGE_LENGTHS = (5, 10, 20, 60)

# --- fixed values: source header -> contract name ---------------------------

CONTRACT_MAPPINGS = {
    "eastmoney_daily_bar": {
        "代码": "ticker", "日期": "trade_date", "股票名称": "name", "开盘": "open",
        "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume",
        "成交额": "amount", "涨跌幅": "pct_change", "换手率": "turnover",
    },
    "eastmoney_snapshot": {
        "代码": "ticker", "股票名称": "name", "最新价": "close", "涨跌幅": "pct_change",
        "成交量": "volume", "成交额": "amount", "换手率": "turnover",
        "总市值": "market_cap", "流通市值": "float_cap", "今开": "open",
        "最高": "high", "最低": "low",
    },
    "akshare_daily_bar": {
        "代码": "ticker", "日期": "trade_date", "开盘": "open", "最高": "high",
        "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount",
        "涨跌幅": "pct_change", "换手率": "turnover",
    },
    "akshare_realtime": {
        "代码": "ticker", "名称": "name", "最新价": "close", "涨跌幅": "pct_change",
        "成交量": "volume", "成交额": "amount", "换手率": "turnover",
        "总市值": "market_cap", "流通市值": "float_cap",
    },
    "sina_realtime": {
        "代码": "ticker", "名称": "name", "最新价": "close", "涨跌额": "change",
        "涨跌幅": "pct_change", "昨收": "pre_close", "今开": "open", "最高": "high",
        "最低": "low", "成交量": "volume", "成交额": "amount",
    },
    "tushare_daily": {
        "ts_code": "ticker", "trade_date": "trade_date", "open": "open", "high": "high",
        "low": "low", "close": "close", "pre_close": "pre_close",
        "pct_chg": "pct_change", "vol": "volume", "amount": "amount",
    },
}

# the 21-column realtime layout used when a landed snapshot is cleaned
REALTIME_21 = {
    "代码": "ticker", "名称": "name", "最新价": "close", "涨跌幅": "pct_change",
    "涨跌额": "chg", "成交量": "volume", "成交额": "amount", "振幅": "amplitude",
    "最高": "high", "最低": "low", "今开": "open", "昨收": "pre_close",
    "换手率": "turnover", "市盈率-动态": "pe_ttm", "市净率": "pb", "总市值": "market_cap",
    "流通市值": "float_cap", "涨速": "rise_speed", "5分钟涨跌": "min5_chg",
    "60日涨跌幅": "day60_pct", "年初至今涨跌幅": "ytd_pct",
}

SNAPSHOT_MAPPINGS = {
    "akshare_realtime": REALTIME_21,
    "eastmoney_realtime": REALTIME_21,
    "sina_realtime": CONTRACT_MAPPINGS["sina_realtime"],
    "tushare_daily": CONTRACT_MAPPINGS["tushare_daily"],
}

# daily file `{yyyy-MM-dd}_Astock.csv`; all headers are required
DAILY_FILE_MAPPING = {
    "trade_date": "trade_date", "代码": "ticker", "名称": "name", "今开": "open",
    "最高": "high", "最低": "low", "最新价": "close", "涨跌幅": "pct_change",
    "成交量": "volume", "成交额": "amount", "换手率": "turnover",
    "总市值": "market_cap", "流通市值": "float_cap", "昨收": "pre_close",
}

# per-stock history, first and second provider
HISTORY_MAPPING = {
    "date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close",
    "volume": "volume", "amount": "amount", "turnover": "turnover",
    "total_mv": "market_cap", "circ_mv": "float_cap",
}

EASTMONEY_HISTORY_MAPPING = {
    "日期": "trade_date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close",
    "成交量": "volume", "成交额": "amount", "换手率": "turnover",
    "总市值": "market_cap", "流通市值": "float_cap",
}

# view of the panel under its older column names
DAILY_BARS_MAPPING = {"ticker": "ts_code", "pct_change": "pct_chg", "volume": "vol"}

# --- fixed values: landed sources, best first -------------------------------

SOURCE_PRIORITY = ("tushare", "sina", "em")

SOURCE_LAYOUTS = {
    "tushare": "tushare_daily",
    "sina": "sina_realtime",
    "em": "eastmoney_realtime",
}
DEFAULT_LAYOUT = "akshare_realtime"

# `2024-01-05_Astock.csv` and `2024-01-05_Astock_sina.csv`
SNAPSHOT_FILE_PATTERN = r"(\d{4}-\d{2}-\d{2})_Astock(?:_([a-z]+))?\.csv$"

# --- fixed values: column orders --------------------------------------------

HISTORY_COLUMNS = (
    "trade_date", "ticker", "open", "high", "low", "close", "pre_close", "pct_change",
    "volume", "amount", "turnover", "market_cap", "float_cap",
)

LOADER_COLUMNS = (
    "trade_date", "ticker", "name", "open", "high", "low", "close", "pre_close",
    "pct_change", "volume", "amount", "turnover", "market_cap", "float_cap",
    "is_st", "is_limit_up", "is_limit_down",
)
