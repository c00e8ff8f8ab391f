"""A rebuild writes what differs and nothing else."""

import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import quality
from tapeloom.session import shared_dir
from tapeloom.sources import raw_files
from tapeloom.sources.store import PANEL, Store

START = date(2024, 1, 10)


@pytest.fixture(params=["day", "month"])
def store(spark, request):
    made = Store(spark, f"reb_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), request.param)
    made.create_tables()
    return made


def panel(spark, *changes):
    rows = {(n, t): float(n) for n in range(0, 60, 3) for t in ("600000.SH", "000001.SZ")} | dict(changes)
    return spark.createDataFrame(
        [(START + timedelta(days=n), t, close) for (n, t), close in rows.items() if close is not None],
        "trade_date date, ticker string, close double").orderBy(F.rand())


def canonical(spark, df):
    path = shared_dir(spark, "canonical")
    raw_files.write_canonical(df, path)
    return path


def files(store):
    parts = store.spark.table(store.name(PANEL)).select(F.input_file_name().alias("f")).distinct().collect()
    return {r.f for r in parts}


def held(store):
    return sorted((r.trade_date, r.ticker, r.close) for r in store.table(PANEL).collect())


def test_only_what_differs_is_written(spark, store):
    df = panel(spark)
    path = canonical(spark, df)
    assert len(store.rebuild(path)) == len(store.periods())
    before, rows = files(store), held(store)
    assert rows == sorted(map(tuple, df.collect()))
    assert store.rebuild(path) == [] and files(store) == before  # load times do not count
    day = START + timedelta(days=9)
    again = store.rebuild(canonical(spark, panel(spark, ((9, "600000.SH"), 99.0))))
    assert again == [store._period_of(day)]
    assert held(store) == sorted(r if r[:2] != (day, "600000.SH") else (*r[:2], 99.0) for r in rows)
    kept = before & files(store)
    assert len(kept) < len(before) and all(store._period_of(day) not in f for f in kept)


def test_swapped_values_are_seen_and_lost_days_go(spark, store):
    store.rebuild(canonical(spark, panel(spark, ((0, "600000.SH"), 5.0), ((3, "600000.SH"), 6.0))))
    swapped = panel(spark, ((0, "600000.SH"), 6.0), ((3, "600000.SH"), 5.0))
    assert store._period_of(START) in store.rebuild(canonical(spark, swapped))
    assert held(store) == sorted(map(tuple, swapped.collect()))
    cut = swapped.where(F.col("trade_date") < F.lit(date(2024, 2, 1)))
    gone = store.rebuild(canonical(spark, cut))
    assert gone and all(p >= "2024-02" for p in gone)
    assert held(store) == sorted(map(tuple, cut.collect()))


def test_a_repeated_key_stops_the_rebuild(spark, store):
    store.rebuild(canonical(spark, panel(spark)))
    before = held(store)
    with pytest.raises(quality.DuplicateKeyError):
        store.rebuild(canonical(spark, panel(spark).union(panel(spark).limit(1).withColumn("close", F.lit(0.5)))))
    assert held(store) == before
