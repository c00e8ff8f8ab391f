"""Series and carry-forward against plain loops on a small random panel."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import calendar as cal
from tapeloom.operators import carry, keys, market, series

START = date(2024, 1, 1)
SCHEMA = "trade_date date, ticker string, close double, volume bigint, amount double"


def day(n):
    return START + timedelta(days=n)


def random_rows(seed, n_days=25, n_tickers=6, share=0.4):
    rng = random.Random(seed)
    return [
        (day(d), f"60000{t}.SH", None if rng.random() < 0.2 else round(rng.uniform(1, 50), 2),
         rng.randrange(1, 99), round(rng.uniform(1, 9), 2))
        for d in range(n_days) for t in range(n_tickers) if rng.random() < share
    ]


def carried_day_by_day(rows, stored=(), max_gap=None):
    """Repeat the single step: copy yesterday's missing tickers with zero volume."""
    store = {}
    for row in stored:
        store.setdefault(row[0], {})[row[1]] = row
    delivered = {}
    for row in rows:
        delivered.setdefault(row[0], {})[row[1]] = row
    for d in sorted(delivered):
        now = dict(delivered[d])
        before = [x for x in store if x < d]
        if before:
            for ticker, row in store[max(before)].items():
                now.setdefault(ticker, (d, ticker, row[2], 0, 0.0))
        store[d] = now
    return sorted(r for d in delivered for r in store[d].values())


def got(df):
    return sorted(tuple(r) for r in df.select("trade_date", "ticker", "close", "volume", "amount").collect())


def comparable(rows):
    return [tuple("" if v is None else v for v in r) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_densify_equals_daily_repetition(spark, seed):
    rows = random_rows(seed)
    dense = carry.densify(spark.createDataFrame(rows, SCHEMA))
    assert sorted(comparable(map(tuple, dense.drop("is_carried").collect()))) == sorted(
        comparable(carried_day_by_day(rows))
    )
    assert dense.where("not is_carried").count() == len(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_carry_forward_onto_history(spark, seed):
    """Deliveries before, between and after stored days, in one batch."""
    rng = random.Random(seed)
    rows = random_rows(seed, n_days=12)
    late = {day(d) for d in rng.sample(range(12), 6)}
    stored = [r for r in rows if r[0] not in late]
    batch = [r for r in rows if r[0] in late]
    out = carry.carry_forward(spark.createDataFrame(batch, SCHEMA), spark.createDataFrame(stored, SCHEMA))
    assert sorted(comparable(map(tuple, out.drop("is_carried").collect()))) == sorted(
        comparable(carried_day_by_day(batch, stored))
    )


def test_max_gap_and_own_calendar(spark):
    panel = spark.createDataFrame([(day(0), "a", 1.0, 5, 5.0), (day(4), "b", 1.0, 5, 5.0)], SCHEMA)
    calendar = spark.createDataFrame([(day(d),) for d in range(5)], "trade_date date")
    dense = carry.densify(panel, calendar, max_gap=2)
    assert sorted((r.trade_date, r.ticker) for r in dense.collect()) == [
        (day(0), "a"), (day(1), "a"), (day(2), "a"), (day(4), "b")
    ]


def test_single_step_leaves_no_null_tickers(spark):
    previous = spark.createDataFrame([(day(1), "a", 1.0, 5, 5.0), (day(1), None, 1.0, 5, 5.0)], SCHEMA)
    current = spark.createDataFrame([(day(1), "b", 2.0, 5, 5.0)], SCHEMA)
    out = carry.carry_missing(current, previous)
    assert sorted((r.ticker, r.volume, r.is_carried) for r in out.collect()) == [
        ("a", 0, True), ("b", 5, False)
    ]


def test_moving_averages(spark):
    rows = random_rows(7, share=0.9)
    df = spark.createDataFrame(rows, SCHEMA)
    exact = {(r.trade_date, r.ticker): (r.ma3, r.ma5) for r in series.moving_averages(df, (3, 5)).collect()}
    plain = {
        (r.trade_date, r.ticker): (r.ma3, r.ma5)
        for r in series.moving_averages(df, (3, 5), places=None).collect()
    }
    for ticker in {r[1] for r in rows}:
        line = sorted(r for r in rows if r[1] == ticker)
        for i, row in enumerate(line):
            for place, n in enumerate((3, 5)):
                frame = [r[2] for r in line[max(0, i - n + 1): i + 1]]
                whole = len(frame) == n and None not in frame
                want = pytest.approx(sum(frame) / n) if whole else None
                assert exact[row[0], ticker][place] == want
                assert plain[row[0], ticker][place] == want


def test_board_streak(spark):
    flags = [True, True, False, True, None, True, True, True]
    df = spark.createDataFrame([(day(i), "a", f) for i, f in enumerate(flags)],
                               "trade_date date, ticker string, is_limit_up boolean")
    out = series.board_streak(df).orderBy("trade_date").collect()
    assert [r.boards for r in out] == [1, 2, 0, 1, 0, 1, 2, 3]


def test_derive_changes_drops_first_row_after_start(spark):
    df = spark.createDataFrame([(day(i), "a", c, 1, 1.0) for i, c in enumerate([10.0, 0.0, 11.0, 12.1])], SCHEMA)
    out = series.derive_changes(df, start=day(1)).orderBy("trade_date").collect()
    assert [(r.pre_close, r.pct_change and round(r.pct_change, 6)) for r in out] == [(0.0, None), (11.0, 10.0)]


def test_keep_last_takes_nulls_of_the_last_row(spark):
    df = spark.createDataFrame(
        [(day(0), "a", 1, "x"), (day(0), "a", 2, "y"), (day(0), "a", 3, None), (day(0), None, 1, "n"), (day(0), None, 2, "m")],
        "trade_date date, ticker string, seq int, name string",
    )
    out = keys.keep_last(df, ["seq"]).collect()
    assert sorted((r.ticker or "", r.name) for r in out) == [("", "m"), ("a", None)]


def test_source_priority_ignores_absent_sources(spark):
    df = spark.createDataFrame(
        [(day(0), "a", "em"), (day(0), "a", "sina"), (day(1), "a", "em"), (day(2), "a", "tushare"), (day(2), "b", "sina")],
        "trade_date date, ticker string, source string",
    )
    out = keys.prefer_source(df).collect()
    assert sorted((r.trade_date, r.source) for r in out) == [
        (day(0), "sina"), (day(1), "em"), (day(2), "tushare")
    ]


def test_latest_trade_date(spark):
    calendar = spark.createDataFrame([(date(2024, 1, 4),), (date(2024, 1, 5),), (date(2024, 1, 8),)], "trade_date date")
    asked = ["2024-01-05 14:59:59", "2024-01-05 15:00:00", "2024-01-06 10:00:00", "2024-01-08 09:00:00",
             "2024-02-01 09:00:00", "2024-01-04 10:00:00", "2023-01-01 10:00:00"]
    moments = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, a string").select(
        "i", F.col("a").cast("timestamp_ntz").alias("a"))
    out = cal.latest_trade_date(moments, calendar, "a", source_zone="Asia/Shanghai").orderBy("i").collect()
    assert [str(r.latest_trade_date) for r in out] == [
        "2024-01-04", "2024-01-05", "2024-01-05", "2024-01-05", "2024-01-08", "None", "None"
    ]


def test_notes_attach_to_every_row(spark):
    panel = spark.createDataFrame([(day(0), "a"), (day(0), "b")], "trade_date date, ticker string")
    notes = spark.createDataFrame(
        [(1, day(0), "stock", "a", "x", None), (2, day(0), "stock", "a", "y", None), (3, day(0), "theme", "b", "600001 up", None)],
        "id int, trade_date date, scope string, key string, content string, created_at timestamp",
    )
    out = market.attach_notes(panel, notes).collect()
    assert sorted((r.ticker, r.note or "") for r in out) == [("a", "x"), ("a", "y"), ("b", "")]
    themes = market.themes_from_notes(notes).collect()
    assert [(t.code, t.theme) for t in themes] == [("600001", "b")]


def test_carried_days_use_no_cross_join(spark):
    panel = spark.createDataFrame(random_rows(1), SCHEMA)
    plan = carry.densify(panel)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
