"""Reading, choosing, checking and loading hand-made files, in batch and as a stream."""

import uuid
from datetime import date

import pytest

from tapeloom.contracts import DAILY_MARKET_SNAPSHOT, build_custom_mapping, get_mapping
from tapeloom.contracts import fixed_values as fixed
from tapeloom.operators import quality
from tapeloom.operators.shaping import conform
from tapeloom.plans import daily, loaders
from tapeloom.session import shared_dir
from tapeloom.sources import raw_files
from tapeloom.sources.store import PANEL, Store
from tapeloom.streaming import landing

HEADERS = list(fixed.DAILY_FILE_MAPPING)
DAYS = ["2024-01-04", "2024-01-05", "2024-01-08"]


def line(day, code, name, close, pre, volume=100):
    row = {"trade_date": day, "代码": code, "名称": name, "今开": close, "最高": close, "最低": close,
           "最新价": close, "涨跌幅": "", "成交量": volume, "成交额": 1000, "换手率": 1, "总市值": "-",
           "流通市值": 1, "昨收": pre}
    return row


def write(path, rows, headers=HEADERS):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join([",".join(headers), *[",".join(str(r[h]) for h in headers) for r in rows]])
    path.write_text("﻿" + text + "\n", encoding="utf-8")
    return str(path)


def new_store(spark):
    store = Store(spark, f"f_{uuid.uuid4().hex[:8]}", shared_dir(spark, "files"))
    store.create_tables()
    return store


@pytest.fixture
def folder(tmp_path):
    """Three daily files; the second has no trade_date column, the last repeats a key."""
    write(tmp_path / "2024" / f"{DAYS[0]}_Astock.csv", [line(DAYS[0], "1", "平安", 11.0, 10.0), line(DAYS[0], "600000", "*ST 浦发", 10.5, 10.0)])
    write(tmp_path / "2024" / f"{DAYS[1]}_Astock.csv", [line("", "1", "平安", 9.9, 11.0)], HEADERS[1:])
    write(tmp_path / "2024" / f"{DAYS[2]}_Astock_em.csv", [line(DAYS[2], "430001", "北", 13.0, 10.0)])
    return tmp_path


def test_choosing_files(spark, folder):
    root = str(folder)
    assert raw_files.snapshot_files(spark, root)[0].endswith(f"{DAYS[2]}_Astock_em.csv")
    assert len(raw_files.snapshot_files(spark, root, year=2024)) == 3
    assert raw_files.snapshot_files(spark, root, date=DAYS[0])[0].endswith(f"{DAYS[0]}_Astock.csv")
    assert len(raw_files.history_files(spark, root, limit=2)) == 2
    with pytest.raises(FileNotFoundError):
        raw_files.snapshot_files(spark, root, year=1999)
    row = raw_files.read_csv(spark, raw_files.snapshot_files(spark, root)).first()
    assert (row.file_source, str(row.file_date)) == ("em", DAYS[2])


def test_loading_daily_files(spark, folder):
    store = new_store(spark)
    report = loaders.load_daily_files(store, raw_files.snapshot_files(spark, str(folder), year=2024))
    assert {r.file_name: r.n_rows for r in report.collect()}[None] == 4
    got = store.snapshot().select("trade_date", "ticker", "is_st", "is_limit_up", "is_limit_down", "market_cap").collect()
    assert [(str(r[0]), *r[1:]) for r in got] == [
        (DAYS[0], "000001.SZ", False, True, False, None), (DAYS[0], "600000.SH", True, True, False, None),
        (DAYS[1], "000001.SZ", False, False, True, None), (DAYS[2], "430001.BJ", False, True, False, None),
    ]


@pytest.mark.parametrize(
    "rows, problem",
    [([line(DAYS[0], "510300", "etf", 1, 1)], "ticker_format"),
     ([line(DAYS[0], "1", "a", 1, 1), line(DAYS[0], "000001", "a", 1, 1)], "repeated_key"),
     ([line(DAYS[1], "1", "a", 1, 1)], "file_date"),
     ([], "files without rows")],
)
def test_broken_files_load_nothing(spark, folder, rows, problem):
    bad = write(folder / "2024" / f"{DAYS[0]}_Astock_sina.csv", rows)
    store = new_store(spark)
    good = str(folder / "2024" / f"{DAYS[2]}_Astock_em.csv")
    with pytest.raises(quality.DataCheckError, match=problem):
        loaders.load_daily_files(store, [good, bad])
    assert store.table(PANEL).count() == 0


def test_key_in_two_files_takes_the_later_one(spark, tmp_path):
    paths = [write(tmp_path / f"{DAYS[0]}_Astock{s}.csv", [line(DAYS[0], "1", "a", c, 10)]) for s, c in (("_em", 1), ("_sina", 2))]
    store = new_store(spark)
    loaders.load_daily_files(store, paths)
    assert [r.close for r in store.snapshot().collect()] == [2.0]


def test_missing_header_is_an_error(spark, tmp_path):
    path = write(tmp_path / f"{DAYS[0]}_Astock.csv", [line(DAYS[0], "1", "a", 1, 1)], HEADERS[:-1])
    with pytest.raises(quality.MissingColumnsError):
        loaders.load_daily_files(new_store(spark), [path])


def test_loading_history_files(spark, tmp_path):
    headers = list(fixed.HISTORY_COLUMNS)
    values = dict.fromkeys(headers, 1)
    for code in ("000001", "600000.SH"):
        rows = [{**values, "trade_date": d, "ticker": code, "close": 11, "pre_close": 10} for d in DAYS]
        write(tmp_path / f"{code}.csv", rows, headers)
    store = new_store(spark)
    paths = raw_files.history_files(spark, str(tmp_path))
    loaders.load_history_files(store, paths, limit=1)
    assert {r.ticker for r in store.snapshot().collect()} == {"000001.SZ"}
    loaders.load_history_files(store, paths)
    assert store.table(PANEL).where("is_limit_up and not is_st and name is null").count() == 6


def test_stream_takes_each_file_once_and_equals_batch(spark, tmp_path):
    headers = ["代码", "名称", "最新价", "昨收", "成交量", "成交额", "trade_date"]
    data = {DAYS[0]: ["1", "2"], DAYS[1]: ["1", "1"], DAYS[2]: ["2"]}
    for i, (day, codes) in enumerate(data.items()):
        write(tmp_path / "in" / f"{day}_Astock_em.csv",
              [line(day, c, f"n{j}", 10 + i + j, 10) for j, c in enumerate(codes)], headers)
    streamed, checkpoint = new_store(spark), shared_dir(spark, "checkpoint")
    stream = landing.read_landing(spark, str(tmp_path / "in"), headers)
    landing.ingest_snapshots(stream, streamed, "em", checkpoint).awaitTermination()
    batch = new_store(spark)
    for day in DAYS:
        rows = raw_files.read_csv(spark, raw_files.snapshot_files(spark, str(tmp_path / "in"), date=day))
        daily.daily_update({"em": rows}, batch, day)
    show = ["trade_date", "ticker", "name", "close", "volume", "pct_change", "is_limit_up"]
    want = [tuple(r) for r in batch.snapshot().select(*show).collect()]
    assert [tuple(r) for r in streamed.snapshot().select(*show).collect()] == want
    assert [(str(r[0]), r[1], r[2], r[4]) for r in want] == [
        (DAYS[0], "000001.SZ", "n0", 100), (DAYS[0], "000002.SZ", "n1", 100), (DAYS[1], "000001.SZ", "n1", 100),
        (DAYS[1], "000002.SZ", "n1", 0), (DAYS[2], "000001.SZ", "n1", 0), (DAYS[2], "000002.SZ", "n0", 100),
    ]
    write(tmp_path / "in" / "2024-01-09_Astock_em.csv", [line("2024-01-09", "2", "late", 13, 10)], headers)
    again = landing.read_landing(spark, str(tmp_path / "in"), headers)
    query = landing.ingest_snapshots(again, streamed, "em", checkpoint)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) <= 2
    assert streamed.snapshot(trade_date=date(2024, 1, 9)).count() == 2


def test_raw_landing_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("20240104", "1"), ("20240105", "2")], "trade_date string, ts_code string")
    path = str(tmp_path / "raw")
    raw_files.write_raw(raw.selectExpr("*", "'tushare' as source"), path)
    back = raw_files.read_raw(spark, path, "tushare")
    assert sorted((r.trade_date, r.ts_code, str(r.file_date)) for r in back.collect()) == [
        ("20240104", "1", DAYS[0]), ("20240105", "2", DAYS[1])
    ]
    with pytest.raises(Exception, match="already exists"):
        raw_files.write_raw(raw.selectExpr("*", "'tushare' as source"), path, mode="error")


def test_mappings_and_schema_checks(spark):
    assert len(get_mapping("akshare_realtime")) == 9
    assert len(get_mapping("akshare_realtime", "snapshot")) == 21
    with pytest.raises(ValueError):
        get_mapping("unknown")
    assert build_custom_mapping({"股票代码": "ticker"}) == {"股票代码": "ticker"}
    df = spark.range(1).selectExpr("'a' as ticker", "id as other")
    with pytest.raises(quality.MissingColumnsError) as error:
        quality.quick_validate(df, PANEL)
    assert "close" in error.value.missing and error.value.table == PANEL
    whole = conform(df, DAILY_MARKET_SNAPSHOT, keep=["other"])
    assert quality.validate_schema(whole, PANEL) == (True, set(), {"other"})
    with pytest.raises(quality.ExtraColumnsError):
        quality.validate_schema(whole, PANEL, allow_extra=False)
    with pytest.raises(quality.ValidationError):
        quality.check_column_order(df, ["other", "ticker"])
    with pytest.raises(quality.TypeConversionError) as error:
        quality.check_conversions(spark.createDataFrame([("x",), ("1",), ("",)], "close string"))
    assert (error.value.column, error.value.errors) == ("close", 1)


def test_load_reports(spark):
    rows = spark.createDataFrame([("a.csv",), ("a.csv",), ("b.csv",)], "file_name string")
    listed = spark.createDataFrame([("a.csv",), ("b.csv",), ("c.csv",)], "file_name string")
    report = raw_files.load_report(rows, listed)
    assert {r.file_name: r.n_rows for r in report.collect()} == {"a.csv": 2, "b.csv": 1, "c.csv": 0, None: 3}
    known = spark.createDataFrame([("b.csv",)], "file_name string")
    outcome = raw_files.load_outcome(report, known)
    assert {r.outcome: r.n_files for r in outcome.collect()} == {"success": 1, "skipped": 1, "failed": 1}
    assert [r.file_name for r in quality.empty_files(listed, rows).collect()] == ["c.csv"]


def test_export_by_ticker(spark, tmp_path):
    path = str(tmp_path / "export")
    rows = spark.createDataFrame([("2024-01-04", "a", 1.0), ("2024-01-04", "b", 2.0)], "trade_date string, ticker string, close double")
    raw_files.export_by_ticker(rows, path)
    back = spark.read.option("header", True).csv(f"{path}/ticker=b")
    assert [(r.trade_date, r.close) for r in back.collect()] == [("2024-01-04", "2.0")]


def tasks_of(spark, group, action):
    """What an action returns, and the tasks of each stage it ran."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return out, [s.numTasks for s in stages if s is not None]


def test_many_tickers_are_one_file_each_and_listed_in_few_tasks(spark, tmp_path):
    """40 folders: over 32 Spark lists them in tasks, by default one for each."""
    path = str(tmp_path / "export")
    rows = spark.range(120).selectExpr(
        "date_add(date'2024-01-04', int(id div 40)) as trade_date", "lpad(id % 40, 6, '0') || '.SZ' as ticker",
        "id / 100 as close", "id as volume",
        "case when id % 7 = 0 then 'two' || char(10) || 'lines, one' when id % 7 < 6 then 'plain' end as note")
    raw_files.export_by_ticker(rows, path)
    assert len(list((tmp_path / "export").glob("ticker=*/*.csv"))) == 40
    assert not list((tmp_path / "export").rglob("*.crc"))
    default = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    back, tasks = tasks_of(spark, "by ticker", lambda: raw_files.read_by_ticker(spark, path, rows.schema))
    assert tasks and max(tasks) <= 8
    assert back.dtypes == rows.dtypes and sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)
    found, tasks = tasks_of(spark, "history", lambda: raw_files.list_files(spark, path, raw_files.HISTORY_GLOB))
    assert tasks and max(tasks) <= 8 and found.count() == 40
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == default


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    headers = list(fixed.HISTORY_COLUMNS)
    values = dict.fromkeys(headers, 1)
    for folder, close in (("a", 11), ("b", 12)):
        write(tmp_path / folder / "000001.csv", [{**values, "trade_date": DAYS[0], "ticker": "000001", "close": close}], headers)
    store = new_store(spark)
    report = loaders.load_history_files(store, raw_files.history_files(spark, str(tmp_path)))
    assert [r.close for r in store.snapshot().collect()] == [12.0]
    assert sorted((r.file_name or "", r.n_rows) for r in report.collect()) == [("", 2), ("000001.csv", 1), ("000001.csv", 1)]
