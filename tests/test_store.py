"""The store in every partition grain, on a few days."""

import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.contracts import ALL_TABLES, DAILY_MARKET_SNAPSHOT, get_table
from tapeloom.operators import quality
from tapeloom.plans import daily
from tapeloom.session import shared_dir
from tapeloom.sources.store import NOTES, PANEL, PHASE, TRADES, Store

D1, D2, D3, D4 = date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 2)
OLD = datetime(2000, 1, 1)


@pytest.fixture(params=["day", "month"])
def store(spark, request):
    made = Store(spark, f"t_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), request.param)
    made.create_tables()
    return made


def bars(spark, *rows):
    return spark.createDataFrame(
        [(*r, *[None] * (6 - len(r))) for r in rows],
        "trade_date date, ticker string, name string, close double, volume double, created_at timestamp",
    )


def held(store, *columns):
    return [tuple(r) for r in store.snapshot().select("trade_date", "ticker", *columns).collect()]


def test_catalog(store):
    assert store.list_tables() == sorted(c.name for c in ALL_TABLES)
    assert {"trade_date", "pre_close"} <= {r.col_name for r in store.describe(PANEL).collect()}
    assert store.table(PANEL).columns == DAILY_MARKET_SNAPSHOT.columns
    with pytest.raises(ValueError):
        get_table("nothing")


def test_append_rejects_known_repeated_and_null_keys(spark, store):
    store.append(PANEL, bars(spark, (D1, "a", "n", 1.0, 2.5), (D2, "a", "n", 1.0, 2.7)))
    assert held(store, "volume") == [(D1, "a", 2), (D2, "a", 3)]
    for rows in ([(D1, "a")], [(D3, "b"), (D3, "b")], [(D3, None)]):
        with pytest.raises(quality.DuplicateKeyError):
            store.append(PANEL, bars(spark, *rows))
    store.append(PANEL, bars(spark, (D1, "b")))
    assert len(held(store)) == 3
    assert store.snapshot().where("created_at is null").count() == 0
    assert [r.trade_date for r in store.days().orderBy("trade_date").collect()] == [D1, D2]


def test_queries_filter(spark, store):
    store.append(PANEL, bars(spark, (D1, "a"), (D2, "b"), (D3, "a"), (D4, "b")))
    assert [r.trade_date for r in store.snapshot(ticker="b").collect()] == [D2, D4]
    assert [r.trade_date for r in store.snapshot(start_date=D2, end_date="2024-02-01").collect()] == [D2, D3]
    assert [r.ticker for r in store.snapshot(trade_date=D3).collect()] == ["a"]
    assert store.previous_trade_date(D3) == D2 and store.previous_trade_date(D1) is None
    assert [r.ticker for r in store.day_before(D3).collect()] == ["b"]
    plan = store.snapshot(trade_date=D3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_replace_by_key_and_upsert(spark, store):
    store.append(PANEL, bars(spark, (D1, "a", "x", 1.0, 5.0, OLD), (D1, "b", "x", 1.0, 5.0, OLD), (D3, "c", "x", 1.0, 5.0, OLD)))
    store.replace_by_key(PANEL, bars(spark, (D1, "a", None, 2.0, None, OLD), (D2, "d", "x", 2.0, 1.0, OLD)))
    assert held(store, "name", "close", "volume") == [
        (D1, "a", None, 2.0, None), (D1, "b", "x", 1.0, 5), (D2, "d", "x", 2.0, 1), (D3, "c", "x", 1.0, 5)
    ]
    batch = bars(spark, (D1, "b", None, 3.0, 6.0), (D4, "e", "new", 3.0, 6.0))
    for _ in range(2):
        store.upsert(batch)
        got = store.snapshot().select("ticker", "name", "close", (F.year("created_at") == 2000).alias("old")).collect()
        assert [tuple(r) for r in got] == [
            ("a", None, 2.0, True), ("b", None, 3.0, True), ("d", "x", 2.0, True), ("c", "x", 1.0, True), ("e", "new", 3.0, False)
        ]
    with pytest.raises(quality.DuplicateKeyError):
        store.upsert(bars(spark, (D1, "b"), (D1, "b")))


def test_replace_day(spark, store):
    store.append(PANEL, bars(spark, (D1, "a"), (D2, "a"), (D2, "b"), (D3, "a")))
    for _ in range(2):
        assert store.replace_day(bars(spark, (D2, "c", "x", 1.0)), D2) == 1
        assert held(store, "close") == [(D1, "a", None), (D2, "c", 1.0), (D3, "a", None)]
    assert store.replace_day(bars(spark), "2024-01-31") == 0
    assert store.replace_day(bars(spark), D3) == 0
    assert held(store) == [(D1, "a")]


def test_one_day_update_equals_many_day_update(spark, store):
    rows = [(D1, "a", "ST x", 1.0, 5.0), (D2, "b", "y", 2.0, 5.0), (D4, "a", "ST x", 3.0, 5.0)]
    cleaned = daily.clean_snapshot(bars(spark, *rows).drop("created_at"), sequence=["ticker"]).persist()
    store.append(PANEL, bars(spark, (D3, "s", "z", 9.0, 5.0)))
    daily.update_days(cleaned.where(F.col("trade_date") == D1), store)
    daily.update_days(cleaned.where(F.col("trade_date") > D1), store)
    many = held(store, "close", "volume", "is_st")
    assert many == [
        (D1, "a", 1.0, 5, True), (D2, "a", 1.0, 0, True), (D2, "b", 2.0, 5, False),
        (D3, "s", 9.0, 5, None), (D4, "a", 3.0, 5, True), (D4, "s", 9.0, 0, False),
    ]
    for d in (D1, D2, D4):
        day = cleaned.where(F.col("trade_date") == d)
        assert store.replace_day(daily.enrich_one_day(day, store, d), d) == sum(r[0] == d for r in many)
    assert held(store, "close", "volume", "is_st") == many
    cleaned.unpersist()


def test_small_tables(spark, store):
    phases = spark.createDataFrame(
        [(D1, "rise", "yes", "0", None, "否", "n", None)],
        "trade_date date, phase string, M1_core string, M2_front string, M3_identifiable string,"
        " V_triggered string, notes string, created_at timestamp",
    )
    store.save(PHASE, phases)
    with pytest.raises(quality.DuplicateKeyError):
        store.save(PHASE, phases)
    store.save(PHASE, phases.withColumn("phase", F.lit("ebb")), replace=True)
    row = store.phases(trade_date=D1).first()
    assert (row.phase, row.M1_core, row.M2_front, row.M3_identifiable, row.V_triggered) == (
        "ebb", True, False, None, False
    )
    trades = spark.createDataFrame([("t2", D2), ("t1", D1), ("t3", None)], "trade_id string, entry_date date")
    store.append(TRADES, trades)
    assert [r.trade_id for r in store.trades().collect()] == ["t1", "t2", "t3"]
    assert store.trades("t2").first().entry_date == D2
    note = spark.createDataFrame([(1, D1, "stock", "a", "c")], "id int, trade_date date, scope string, key string, content string")
    store.add_note(note)
    with pytest.raises(quality.DataCheckError):
        store.add_note(note.withColumn("scope", F.lit("other")))
    assert store.table(NOTES).count() == 1
    with pytest.raises(quality.MissingColumnsError):
        store.save(PHASE, phases.drop("notes"))


def test_realtime_delivery_without_a_date(spark, store):
    store.append(PANEL, bars(spark, (D1, "000001.SZ", "x", 10.0), (D2, "000001.SZ", "x", 10.5), (D1, "600000.SH", "y", 5.0)))
    sent = spark.createDataFrame([("000001", "x", 11.0)], "`代码` string, `名称` string, `最新价` double")
    assert daily.daily_update({"sina": sent}, store, D2, shared_dir(spark, "raw"), sequence=["代码"]) == 2
    assert held(store, "close", "is_carried")[2:] == [(D2, "000001.SZ", 11.0, False), (D2, "600000.SH", 5.0, True)]
    before = held(store, "close", "is_carried")
    with pytest.raises(quality.DataCheckError):
        daily.daily_update({"sina": sent.limit(0)}, store, D2, sequence=["代码"])
    assert held(store, "close", "is_carried") == before
    store.upsert(bars(spark, (D2, "600000.SH", "y", 5.5)))
    assert held(store, "close", "is_carried")[3] == (D2, "600000.SH", 5.5, False)


def test_note_ids_are_unique(spark, store):
    note = spark.createDataFrame([(1, D1, "stock", "a", "c")], "id int, trade_date date, scope string, key string, content string")
    store.add_note(note)
    for again in (note, note.withColumn("id", F.lit(2)).union(note.withColumn("id", F.lit(2)))):
        with pytest.raises(quality.DuplicateKeyError):
            store.add_note(again)
    assert store.table(NOTES).count() == 1


def test_previous_date_reads_one_period(spark, store):
    store.append(PANEL, bars(spark, (D1, "a"), (D2, "a"), (D4, "a")))
    assert [store.previous_trade_date(d) for d in (D1, D2, D3, D4)] == [None, D1, D2, D2]


def test_codes_of_more_than_a_thousand_stocks_stay_distinct(spark):
    from tapeloom.driver import adapter, sql
    from tapeloom.functions import tickers
    codes = spark.range(12_000).select(adapter.stock_code(F.col("id")).alias("code"), (F.col("id") % 50 == 49).alias("odd"))
    assert codes.where("not odd").select(tickers.bare_code(F.col("code"))).distinct().count() == 11_760
    import duckdb
    want = duckdb.sql(f"SELECT {sql.code_of('k')} FROM range(12000) t(k)").fetchall()
    assert [tuple(r) for r in codes.select("code").collect()] == want


def test_streamed_and_realtime_rows_of_stocks_past_thirty_thousand_stay(spark, tmp_path):
    from tapeloom.driver import adapter, store_queries

    keys, days = [8, 30008, 32008, 40008], ["1998-01-05", "1998-01-06", "1998-01-07"]
    spark.createDataFrame(
        [(k, d, 5.0, k + n, n, 1) for k in keys for n, d in enumerate(days)],
        "l_suppkey long, l_shipdate string, l_quantity double, l_orderkey long, l_partkey long, l_linenumber int",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"S{k}") for k in keys], "s_suppkey long, s_name string").write.parquet(
        str(tmp_path / "supplier.parquet"))
    rows = adapter.listed(spark, str(tmp_path)).select("trade_date", "ticker", "close").collect()
    closes = {(str(r.trade_date), r.ticker): r.close for r in rows}
    assert len(closes) == 12
    for name, some in (("stream_daily_ingest", days), ("source_switch", days[1:]), ("daily_update_realtime", days[2:])):
        got = getattr(store_queries, name)(spark, str(tmp_path)).collect()
        assert len(got) == 4 * len(some), name
        assert {(str(r.trade_date), r.ticker): r.close for r in got} == {
            k: v for k, v in closes.items() if k[0] in some}, name
