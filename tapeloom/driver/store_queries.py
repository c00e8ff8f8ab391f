"""Queries that write a store and return what it then holds.

The first delivery is the bars of lines not returned, the second the bars of
returned lines; both cover most stocks and days and overlap in part.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..contracts import ALL_TABLES, DAILY_MARKET_SNAPSHOT
from ..contracts import fixed_values as fixed
from ..functions import tickers
from ..operators import market
from ..operators.keys import with_keys_not_in
from ..plans import daily, daily_view, late, loaders, review
from ..session import shared_dir
from ..sources import raw_files
from ..sources.store import NOTES, PANEL, PHASE, TRADES, Store
from ..streaming import landing, ordered
from . import adapter, sql
from .registry import query

_COLUMNS = ["trade_date", "ticker", "name", "open", "high", "low", "close", "volume", "amount"]
_SELECT = ", ".join(_COLUMNS)

_TWO = (
    "WITH " + sql.listed("b_", "WHERE l.l_returnflag <> 'R'")
    + ", " + sql.listed("n_", "WHERE l.l_returnflag = 'R'")
)


def new_store(spark, label: str, contracts=ALL_TABLES) -> Store:
    """An empty store. The derived days hold kilobytes at the scales at hand, so
    the partitions are months."""
    name = f"{label}_{uuid.uuid4().hex[:8]}"
    store = Store(spark, name, shared_dir(spark, label), grain="month")
    store.create_tables(contracts)
    return store


def _first(spark, sf_dir):
    lines = adapter.read(spark, sf_dir, "lineitem")
    return adapter.listed(spark, sf_dir, lines.where("l_returnflag <> 'R'"))


def _second(spark, sf_dir):
    lines = adapter.read(spark, sf_dir, "lineitem")
    return adapter.listed(spark, sf_dir, lines.where("l_returnflag = 'R'"))


def _stored(store: Store, *extra: str):
    return store.snapshot().select(*_COLUMNS, *extra)


@query(
    _TWO + f""" SELECT {_SELECT} FROM n_listed
    UNION ALL SELECT {_SELECT} FROM b_listed
    WHERE trade_date NOT IN (SELECT trade_date FROM n_listed)"""
)
def replace_day(spark, sf_dir):
    store = new_store(spark, "replace_day")
    store.append(PANEL, _first(spark, sf_dir))
    store.replace_days(_second(spark, sf_dir))
    return _stored(store)


@query(
    _TWO + f""" SELECT {_SELECT} FROM n_listed
    UNION ALL SELECT {_SELECT} FROM b_listed b WHERE NOT EXISTS (
      SELECT 1 FROM n_listed n WHERE n.trade_date = b.trade_date AND n.ticker = b.ticker)"""
)
def replace_by_key(spark, sf_dir):
    store = new_store(spark, "replace_by_key")
    store.append(PANEL, _first(spark, sf_dir))
    store.replace_by_key(PANEL, _second(spark, sf_dir))
    return _stored(store)


@query(
    _TWO + f""" SELECT {_SELECT} FROM b_listed
    UNION ALL SELECT {_SELECT} FROM n_listed n WHERE NOT EXISTS (
      SELECT 1 FROM b_listed b WHERE n.trade_date = b.trade_date AND n.ticker = b.ticker)"""
)
def append_checked(spark, sf_dir):
    store = new_store(spark, "append_checked")
    store.append(PANEL, _first(spark, sf_dir))
    store.append(PANEL, with_keys_not_in(_second(spark, sf_dir), store.table(PANEL)))
    return _stored(store)


@query(
    _TWO + """ SELECT coalesce(n.trade_date, b.trade_date) AS trade_date,
      coalesce(n.ticker, b.ticker) AS ticker,
      CASE WHEN n.ticker IS NOT NULL THEN
        CASE WHEN n.name LIKE '*ST%' THEN NULL ELSE n.name END ELSE b.name END AS name,
      coalesce(n.open, b.open) AS open, coalesce(n.high, b.high) AS high,
      coalesce(n.low, b.low) AS low, coalesce(n.close, b.close) AS close,
      coalesce(n.volume, b.volume) AS volume, coalesce(n.amount, b.amount) AS amount,
      b.ticker IS NULL AS is_new
    FROM b_listed b FULL JOIN n_listed n ON n.trade_date = b.trade_date AND n.ticker = b.ticker"""
)
def upsert(spark, sf_dir):
    """The second delivery misses some names; its NULLs win over stored names, and
    ``created_at`` tells new rows from updated ones."""
    store = new_store(spark, "upsert")
    first = _first(spark, sf_dir).withColumn("created_at", F.lit("2000-01-01").cast("timestamp"))
    second = _second(spark, sf_dir).withColumn(
        "name", F.when(~F.col("name").startswith("*ST"), F.col("name"))
    )
    store.append(PANEL, first)
    store.upsert(second)
    held = store.snapshot().withColumn("is_new", F.year("created_at") > 2000)
    return held.select(*_COLUMNS, "is_new")


@query(
    sql.PANEL + """ SELECT trade_date, ticker, close, CASE WHEN trade_date >= DATE '1998-01-01'
      THEN pre_close END AS pre_close FROM panel"""
)
def table_migration(spark, sf_dir):
    """A table made before ``pre_close`` existed gains it; later loads fill it."""
    fields = [f for f in DAILY_MARKET_SNAPSHOT.schema.fields if f.name != "pre_close"]
    old = replace(DAILY_MARKET_SNAPSHOT, schema=StructType(fields))
    store = new_store(spark, "table_migration", [old])
    panel = adapter.kept(adapter.panel(spark, sf_dir))
    store.append(PANEL, panel)
    store.ensure_column("pre_close")
    store.upsert(panel.where("trade_date >= date'1998-01-01'"))
    return store.snapshot().select("trade_date", "ticker", "close", "pre_close")


def _broken_dates(spark, sf_dir, store: Store) -> str:
    broken = store.name("timed_snapshot")
    timed = adapter.listed(spark, sf_dir).withColumn(
        "trade_date", F.col("trade_date").cast("timestamp") + F.expr("interval 15 hours")
    )
    timed.write.saveAsTable(broken)
    return "timed_snapshot"


@query(sql.LISTED + f" SELECT {_SELECT} FROM listed")
def date_repair(spark, sf_dir):
    store = new_store(spark, "date_repair")
    store.repair_trade_date(_broken_dates(spark, sf_dir, store))
    return _stored(store)


@query(
    sql.LISTED + """, newest AS (
      SELECT string_agg(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date DESC) AS d,
             string_agg(CAST(trade_date AS VARCHAR) || ' 15:00:00', ',' ORDER BY trade_date DESC) AS t
      FROM (SELECT DISTINCT trade_date FROM listed ORDER BY trade_date DESC LIMIT 5))
    SELECT 'before' AS stage, (SELECT count(*) FROM listed) AS n_rows, t AS newest_dates FROM newest
    UNION ALL SELECT 'after', (SELECT count(*) FROM listed), d FROM newest"""
)
def date_repair_report(spark, sf_dir):
    store = new_store(spark, "date_repair_report")
    report = store.repair_trade_date(_broken_dates(spark, sf_dir, store))
    return report.withColumn("newest_dates", F.array_join("newest_dates", ","))


@query(sql.LISTED + f" SELECT {_SELECT} FROM listed")
def rebuild_from_canonical(spark, sf_dir):
    """The store is filled with another delivery first; the rebuild replaces it."""
    store = new_store(spark, "rebuild")
    path = shared_dir(spark, "canonical")
    store.append(PANEL, _second(spark, sf_dir))
    raw_files.write_canonical(adapter.listed(spark, sf_dir), path, grain="year")
    store.rebuild(path)
    return _stored(store)


@query(
    sql.BARS + ", " + sql.PHASES + """ SELECT trade_date,
      CASE WHEN "M1_core" THEN 'revised' ELSE phase END AS phase, "M1_core" FROM phases"""
)
def phase_table(spark, sf_dir):
    """Recorded phases, some of them replaced by key."""
    store = new_store(spark, "phase_table")
    phases = adapter.phases(spark, sf_dir)
    store.save(PHASE, phases)
    store.save(PHASE, phases.where("M1_core").withColumn("phase", F.lit("revised")), replace=True)
    return store.phases().select("trade_date", "phase", "M1_core")


@query("WITH " + sql.NOTES + " SELECT id, trade_date, scope, key, content FROM notes")
def note_table(spark, sf_dir):
    store = new_store(spark, "note_table")
    notes = adapter.notes(spark, sf_dir)
    store.add_note(notes.where("scope = 'stock'"))
    store.add_note(notes.where("scope <> 'stock'"))
    return market.journal(store.table(NOTES)).drop("created_at")


# --- files and stream -------------------------------------------------------------------

_HEADERS = {
    "ticker": "代码", "name": "名称", "open": "今开", "high": "最高", "low": "最低",
    "close": "最新价", "pct_change": "涨跌幅", "volume": "成交量", "amount": "成交额",
    "turnover": "换手率", "market_cap": "总市值", "float_cap": "流通市值", "pre_close": "昨收",
}


def _land_files(spark, sf_dir) -> tuple[str, list[str]]:
    """The whole panel as daily-loader CSV text, compressed, a folder per year."""
    path = shared_dir(spark, "landing")
    panel = adapter.panel(spark, sf_dir).withColumns(
        {
            "ticker": tickers.without_suffix(F.col("ticker")),
            **{c: F.lit(None).cast("double") for c in ("turnover", "market_cap", "float_cap")},
        }
    )
    text = panel.withColumnsRenamed(_HEADERS).withColumn("year", F.year("trade_date"))
    columns = ["trade_date", *_HEADERS.values()]
    (
        text.select(*columns, "year").hint("rebalance", "year")
        .write.partitionBy("year").option("header", "true").option("compression", "gzip").csv(path)
    )
    return path, columns


_LOADED = [
    "trade_date", "ticker", "name", "close", "pre_close", "pct_change", "volume", "amount",
    "is_st", "is_limit_up", "is_limit_down",
]


@query(sql.FLAGGED + f" SELECT {', '.join(_LOADED)} FROM flagged")
def load_daily_files(spark, sf_dir):
    """Daily-file loader: CSV text, suffixes, price-limit flags, checks, upsert."""
    path, columns = _land_files(spark, sf_dir)
    store = new_store(spark, "load_daily")
    raw = raw_files.read_csv(spark, f"{path}/year=*", columns)
    shaped = adapter.kept(loaders.shape_daily(raw, keep=loaders.FILE_KEYS))  # every check takes the rows
    store.upsert(loaders.checked(shaped, adapter.TICKER_FORM))
    return store.snapshot().select(*_LOADED)


@query(sql.FLAGGED + f" SELECT {', '.join(_LOADED)} FROM flagged")
def stream_daily_files(spark, sf_dir):
    """The same load as an incremental file stream."""
    path, columns = _land_files(spark, sf_dir)
    store = new_store(spark, "stream_daily")
    stream = landing.read_landing(spark, path, columns, max_files=100)
    landing.ingest_daily_files(
        stream, store, shared_dir(spark, "checkpoint"), adapter.TICKER_FORM
    ).awaitTermination()
    return store.snapshot().select(*_LOADED)


_ENRICHED = ["trade_date", "ticker", "close", "pct_change", "volume", "amount", "is_st",
             "is_limit_up", "is_limit_down"]


_FILLED = (
    sql.PANEL + """, days AS (SELECT DISTINCT trade_date FROM panel),
    spans AS (SELECT *, lead(trade_date) OVER (PARTITION BY ticker ORDER BY trade_date) AS nd FROM panel),
    dense AS (
      SELECT d.trade_date, s.ticker, s.close, s.pct_change, s.is_st,
             CASE WHEN d.trade_date > s.trade_date THEN 0 ELSE s.volume END AS volume,
             CASE WHEN d.trade_date > s.trade_date THEN 0e0 ELSE s.amount END AS amount
      FROM spans s JOIN days d ON d.trade_date >= s.trade_date
       AND d.trade_date < coalesce(s.nd, DATE '9999-12-31'))
    SELECT trade_date, ticker, close, pct_change, volume, amount, is_st,
      coalesce(pct_change >= CASE WHEN is_st THEN 4.9e0 WHEN substr(ticker, 1, 3) IN ('688', '300')
        THEN 19.9e0 ELSE 9.9e0 END, false) AS is_limit_up,
      coalesce(pct_change <= -(CASE WHEN is_st THEN 4.9e0 WHEN substr(ticker, 1, 3) IN ('688', '300')
        THEN 19.9e0 ELSE 9.9e0 END), false) AS is_limit_down
    FROM dense"""
)


@query(_FILLED)
def stream_daily_ingest(spark, sf_dir):
    """Landed realtime snapshots: clean, carry forward, enrich, replace days."""
    path, columns = _land_files(spark, sf_dir)
    store = new_store(spark, "stream_ingest")
    stream = landing.read_landing(spark, path, columns)
    landing.ingest_snapshots(
        stream, store, "em", shared_dir(spark, "checkpoint")
    ).awaitTermination()
    return store.snapshot().select(*_ENRICHED)


@query(_FILLED)
def stream_shuffled_days(spark, sf_dir):
    """The same files landed in an order that splits every day and puts years behind later
    ones, taken in a few at a time."""
    path, store = shared_dir(spark, "shuffled"), new_store(spark, "stream_shuffled")
    landed, columns = _land_files(spark, sf_dir)
    text = spark.read.schema(raw_files.text_schema(columns)).option("header", "true").csv(f"{landed}/year=*")
    part = F.pmod(F.substring("trade_date", 4, 1).cast("int") + 2 * F.pmod(F.xxhash64("代码"), F.lit(2)), F.lit(4))
    for n in (2, 0, 3, 1):  # files grow with the input, not in number: a batch costs passes over the days it holds
        text.where(part == n).repartitionByRange(4, "trade_date").write.option("header", "true").csv(f"{path}/{n}")
    stream = landing.read_landing(spark, path, columns, max_files=2)
    ordered.ingest_in_order(stream, store, "em", shared_dir(spark, "checkpoint"), hold=3).awaitTermination()
    ordered.OrderedLanding(store).finish()
    return store.snapshot().select(*_ENRICHED)


@query(_FILLED)
def late_day(spark, sf_dir):
    """A filled store gets days it never had, and corrected rows of days it has."""
    store = new_store(spark, "late_day")
    panel = adapter.kept(adapter.panel(spark, sf_dir))
    missed, wrong = F.dayofmonth("trade_date") % 7 == 3, F.substring("ticker", 6, 1) == "4"
    early = panel.where(~missed).withColumn("close", F.when(wrong, F.col("close") + 1).otherwise(F.col("close")))
    daily.update_days(early, store)
    late.refill_days(panel.where(missed | wrong), store)
    return store.snapshot().select(*_ENRICHED)


def _ma(n: int) -> str:
    frame = f"(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count(close) OVER {frame} = {n} THEN CAST(sum(CAST(round(close * 10000) AS BIGINT))"
            f" OVER {frame} AS DOUBLE) / {n * 10000}e0 END AS ma{n}")


@query(
    sql.VIEW + f""", averaged AS (SELECT trade_date, ticker, close, pre_close AS last_close, is_limit_up, boards,
      candle_state, {", ".join(map(_ma, (5, 10, 20, 60)))} FROM market)
    SELECT * FROM averaged
    WHERE trade_date IN (SELECT DISTINCT trade_date FROM listed ORDER BY trade_date DESC LIMIT 3)"""
)
def daily_view_from_state(spark, sf_dir):
    """The newest three days' views, each from the state of the day before. The first state is
    made from the history but for its last 40 days, which are then folded in at once."""
    store = new_store(spark, "view_from_state")
    store.append(PANEL, adapter.panel(spark, sf_dir))
    days = sorted(row.trade_date for row in store.days().collect())
    own = daily_view.DailyView(store)
    own.start(days[-min(40, len(days))])
    out = None
    for day in days[-3:]:
        one = own.view(day, places=4).select(
            "trade_date", "ticker", "close", "last_close", "is_limit_up", "boards", "candle_state",
            "ma5", "ma10", "ma20", "ma60")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    sql.RAW + """, own AS (SELECT trade_date, code_text, name_text, close_text, volume_text, seq,
      source FROM raw) SELECT * FROM own"""
)
def raw_landing(spark, sf_dir):
    """Raw text rows landed by year and source, and read back per source."""
    folders = ("year", "source")
    path = shared_dir(spark, "raw")
    columns = ["code_text", "name_text", "close_text", "volume_text", "seq"]
    raw = adapter.raw(spark, sf_dir).select("trade_date", *columns, "source")
    text = raw.withColumn("trade_date", F.col("trade_date").cast("string"))
    raw_files.write_raw(text, path, folders=folders)
    out = None
    for source in ("tushare", "sina", "em"):
        part = raw_files.read_raw(spark, path, source, folders).select(
            F.col("trade_date").cast("date").alias("trade_date"),
            "code_text",
            "name_text",
            "close_text",
            F.coalesce("volume_text", F.lit("")).alias("volume_text"),
            F.col("seq").cast("bigint").alias("seq"),
            "source",
        )
        out = part if out is None else out.unionByName(part)
    return out


_BY_PCT = """coalesce(pct_change >= CASE WHEN is_st THEN 4.9e0
    WHEN substr(ticker, 1, 3) IN ('688', '300') THEN 19.9e0 ELSE 9.9e0 END, false) AS is_limit_up"""
_LAST_TWO = sql.PANEL + """, newest AS (SELECT max(trade_date) AS d FROM panel),
    before AS (SELECT max(trade_date) AS d FROM panel WHERE trade_date < (SELECT d FROM newest)),
    today AS (SELECT * FROM panel WHERE trade_date = (SELECT d FROM newest)),
    earlier AS (SELECT * REPLACE ((SELECT d FROM newest) AS trade_date) FROM panel
      WHERE trade_date = (SELECT d FROM before))"""


def _tushare(rows):
    return rows.select(
        F.col("ticker").alias("ts_code"),
        F.date_format("trade_date", "yyyyMMdd").alias("trade_date"),
        F.col("pct_change").alias("pct_chg"),
        F.col("volume").alias("vol"),
        "name", "open", "high", "low", "close", "pre_close", "amount",
    )


def _realtime(rows):
    """Rows under realtime headers: codes without exchange and no date."""
    text = rows.withColumn("ticker", tickers.without_suffix(F.col("ticker"))).drop("trade_date")
    return text.withColumnsRenamed({k: v for k, v in _HEADERS.items() if k in text.columns})


def _newest_days(panel) -> list:
    newest = panel.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(2)
    return [row.trade_date for row in newest.collect()]


@query(
    _LAST_TWO + f""" SELECT trade_date, ticker, close, pct_change, is_st, {_BY_PCT} FROM today
    UNION ALL SELECT trade_date, ticker, close, pct_change, is_st, {_BY_PCT} FROM earlier
    WHERE ticker NOT IN (SELECT ticker FROM today)"""
)
def daily_update(spark, sf_dir):
    """The newest day's update onto a store that holds the whole history before it."""
    store = new_store(spark, "daily_update")
    panel = adapter.kept(adapter.panel(spark, sf_dir))
    latest = _newest_days(panel)[0]
    store.append(PANEL, panel.where(F.col("trade_date") < latest))
    landed = _tushare(panel.where(F.col("trade_date") == latest))
    daily.daily_update({"tushare": landed}, store, latest, sequence=["ts_code"])
    return store.snapshot(trade_date=latest).select(
        "trade_date", "ticker", "close", "pct_change", "is_st", "is_limit_up"
    )


@query(
    _LAST_TWO + """, chosen AS (SELECT ticker FROM today
      WHERE substr(ticker, 6, 1) IN ('0', '2', '4', '6', '8')
        OR NOT EXISTS (SELECT 1 FROM today WHERE substr(ticker, 6, 1) IN ('0', '2', '4', '6', '8'))),
    sent AS (SELECT * FROM today WHERE ticker IN (SELECT ticker FROM chosen))
    SELECT trade_date, ticker, close, volume, false AS is_carried FROM sent
    UNION ALL SELECT trade_date, ticker, close, 0 AS volume, true FROM earlier
    WHERE ticker NOT IN (SELECT ticker FROM sent)"""
)
def daily_update_realtime(spark, sf_dir):
    """Realtime deliveries without a date, landed raw and kept as canonical files.

    The better source has only stocks with an even code; the other's rows of that
    day are used only if it has none.
    """
    store = new_store(spark, "daily_realtime")
    panel = adapter.kept(adapter.panel(spark, sf_dir))
    latest = _newest_days(panel)[0]
    store.append(PANEL, panel.where(F.col("trade_date") < latest))
    today = panel.where(F.col("trade_date") == latest)
    even = F.substring("ticker", 6, 1).isin("0", "2", "4", "6", "8")
    daily.daily_update(
        {"sina": _realtime(today.where(even)), "em": _realtime(today)}, store, latest,
        shared_dir(spark, "raw"), shared_dir(spark, "canonical"), sequence=["代码"],
    )
    return store.snapshot(trade_date=latest).select(
        "trade_date", "ticker", "close", "volume", "is_carried"
    )


@query(
    _LAST_TWO + """ SELECT trade_date, ticker, close FROM panel
    WHERE trade_date = (SELECT d FROM before)
    UNION ALL SELECT trade_date, ticker, close FROM today
    UNION ALL SELECT trade_date, ticker, close FROM earlier
    WHERE ticker NOT IN (SELECT ticker FROM today)"""
)
def source_switch(spark, sf_dir):
    """One source's suffixed tickers on a day, another's bare codes on the next."""
    store = new_store(spark, "source_switch")
    panel = adapter.panel(spark, sf_dir)
    latest, before = _newest_days(panel)
    first, second = (panel.where(F.col("trade_date") == day) for day in (before, latest))
    daily.daily_update({"tushare": _tushare(first)}, store, before, sequence=["ts_code"])
    daily.daily_update({"em": _realtime(second)}, store, latest, sequence=["代码"])
    return store.snapshot().select("trade_date", "ticker", "close")


@query(sql.VIEW + " SELECT trade_date, ticker, close, is_limit_up, boards FROM market")
def view_after_carry(spark, sf_dir):
    """Review view over a store whose newest two days were filled by carrying."""
    store = new_store(spark, "view_after_carry")
    panel = adapter.kept(adapter.panel(spark, sf_dir))
    before = _newest_days(panel)[1]
    store.append(PANEL, panel.where(F.col("trade_date") < before))
    daily.update_days(panel.where(F.col("trade_date") >= before), store)
    view = review.market_view(store.snapshot())
    return view.select("trade_date", "ticker", "close", "is_limit_up", "boards")


@query(
    sql.FLAGGED + f""" SELECT {', '.join(_LOADED)} FROM flagged"""
)
def load_history_files(spark, sf_dir):
    """History loader over one file or more for each stock; many share a name."""
    path = shared_dir(spark, "history")
    absent = {c: F.lit(None).cast("double") for c in ("turnover", "market_cap", "float_cap")}
    panel = adapter.panel(spark, sf_dir).withColumns({**absent, "stock": F.col("ticker")})
    (
        panel.select(*fixed.HISTORY_COLUMNS, "name", "stock").hint("rebalance", "stock")
        .write.partitionBy("stock").option("header", "true").options(**raw_files.PLAIN_FILES).csv(path)
    )
    store = new_store(spark, "load_history")
    loaders.load_history_files(store, raw_files.history_files(spark, path), form=adapter.TICKER_FORM)
    return store.snapshot().select(*_LOADED)


@query(sql.LISTED + " SELECT trade_date, ticker, close, volume FROM listed")
def export_by_ticker(spark, sf_dir):
    """The export of a folder for each stock, read back."""
    path = shared_dir(spark, "export")
    rows = adapter.listed(spark, sf_dir).select("trade_date", "ticker", "close", "volume")
    raw_files.export_by_ticker(rows, path)
    return raw_files.read_by_ticker(spark, path, rows.schema)


@query(
    sql.LISTED + ", " + sql.PHASES + ", " + sql.NOTES + ", " + sql.TRADES + """
    SELECT 'daily_market_snapshot' AS table_name, count(*) AS n_rows FROM listed
    UNION ALL SELECT 'market_phase', count(*) FROM phases
    UNION ALL SELECT 'notes', count(*) FROM notes
    UNION ALL SELECT 'trade_execution', count(*) FROM trades"""
)
def catalog(spark, sf_dir):
    """The store's tables and their rows."""
    store = new_store(spark, "catalog")
    store.append(PANEL, adapter.listed(spark, sf_dir))
    store.append(PHASE, adapter.phases(spark, sf_dir))
    store.append(TRADES, adapter.trades(spark, sf_dir))
    store.add_note(adapter.notes(spark, sf_dir))
    out = None
    for name in store.list_tables():
        one = store.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out
