"""How often a write reads its source, and what its checks stop."""

import os
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import quality
from tapeloom.session import shared_dir
from tapeloom.sources.store import PANEL, Store

SCHEMA = "trade_date date, ticker string, close double"


@pytest.fixture(params=["day", "month"])
def store(spark, request):
    made = Store(spark, f"one_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), request.param)
    made.create_tables()
    return made


def source(spark, folder, first, n=40):
    """Rows of n days that leave a file for each task that makes them."""
    os.makedirs(folder, exist_ok=True)

    def made(batches):
        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            yield from batches

    days = spark.range(n).repartition(3).mapInArrow(made, "id long")
    return days.select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("trade_date"),
        F.concat(F.lit("t"), F.col("id") % 4).alias("ticker"), F.col("id").cast("double").alias("close"))


@pytest.mark.parametrize("write", ["append", "replace_by_key", "upsert", "replace_days"])
def test_each_write_reads_its_source_once(spark, store, tmp_path, write):
    first = date(2024, 1, 20)
    store.append(PANEL, source(spark, str(tmp_path / "first"), first))
    assert len(os.listdir(tmp_path / "first")) == 3
    df = source(spark, str(tmp_path / write), first + timedelta(days=40 if write == "append" else 20))
    getattr(store, write)(*([PANEL, df] if write in ("append", "replace_by_key") else [df]))
    assert len(os.listdir(tmp_path / write)) == 3
    assert store.table(PANEL).count() == (80 if write == "append" else 60)
    staging = f"{store.root.removeprefix('file:')}/_staging"
    assert not os.path.isdir(staging) or os.listdir(staging) == []


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def test_a_stopped_write_leaves_the_table(spark, store):
    day = date(2024, 1, 31)
    good = rows(spark, (day, "a", 1.0), (day + timedelta(days=1), "a", 2.0))
    store.append(PANEL, good)
    before = sorted(map(tuple, store.table(PANEL).select("trade_date", "ticker", "close").collect()))
    for bad, message in (
        (rows(spark, (day, "b", 1.0), (day, "b", 2.0)), "repeated"), (rows(spark, (day, None, 1.0)), "NULL"),
        (rows(spark, (None, "c", 1.0)), "NULL"),
    ):
        for write in (lambda df: store.append(PANEL, df), lambda df: store.replace_by_key(PANEL, df),
                      store.upsert, store.replace_days):
            with pytest.raises(quality.DuplicateKeyError, match=message):
                write(bad)
    with pytest.raises(quality.DuplicateKeyError, match="already stored.*2024-01-31, a"):
        store.append(PANEL, rows(spark, (day, "z", 1.0), (day, "a", 5.0)))
    assert sorted(map(tuple, store.table(PANEL).select("trade_date", "ticker", "close").collect())) == before


def test_days_beyond_the_bitmap_are_found_too(spark, store):
    days = [date(1950, 3, 1), date(1970, 1, 1), date(2059, 9, 18), date(2059, 9, 19), date(2200, 1, 1)]
    for some in (days[1:3], days[:1], days[3:]):
        store.append(PANEL, rows(spark, *[(d, "a", 1.0) for d in some]))
    store.upsert(rows(spark, *[(d, "a", 2.0) for d in days]))
    got = store.table(PANEL).orderBy("trade_date").collect()
    assert [(r.trade_date, r.close) for r in got] == [(d, 2.0) for d in days]


def test_an_empty_batch_changes_nothing(spark, store):
    store.append(PANEL, rows(spark, (date(2024, 1, 31), "a", 1.0)))
    none = rows(spark, (date(2024, 1, 31), "a", 1.0)).where("false")
    for write in (lambda df: store.append(PANEL, df), lambda df: store.replace_by_key(PANEL, df),
                  store.upsert, store.replace_days):
        write(none)
    assert store.table(PANEL).count() == 1
