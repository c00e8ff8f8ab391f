"""Checks run in one round of tasks and shuffle keys alone; queries derive their input once."""

import os
import uuid
from datetime import date

import pytest

from tapeloom import driver
from tapeloom.driver import adapter
from tapeloom.operators import quality
from tapeloom.session import shared_dir
from tapeloom.sources.store import PANEL, Store

SMALL = "/root/testdata/sf0.001"


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_check_that_finds_nothing_needs_no_rounds(spark):
    rows = spark.range(0, 400, 1, 100)
    assert jobs_of(spark, lambda: quality.require_clean(rows.where("id < 0"))) <= 2
    with pytest.raises(quality.DataCheckError, match="id=7"):
        quality.require_clean(rows.where("id = 7"))


def test_a_write_shuffles_keys_alone_for_its_check(spark, monkeypatch):
    store = Store(spark, f"thin_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), "month")
    store.create_tables()

    def whole_rows(df, key):
        raise AssertionError("whole rows were shuffled by key")

    monkeypatch.setattr(quality, "with_unique_key", whole_rows)
    rows = spark.createDataFrame([(date(2024, 1, 31), "a", 1.0)], "trade_date date, ticker string, close double")
    store.append(PANEL, rows)
    store.upsert(rows.selectExpr("trade_date", "ticker", "close + 1 AS close"))
    store.replace_by_key(PANEL, rows)
    store.replace_days(rows)
    for twice in (store.upsert, store.replace_days, lambda df: store.replace_by_key(PANEL, df)):
        with pytest.raises(quality.DuplicateKeyError, match="repeated.*2024-01-31, a"):
            twice(rows.union(rows))
    with pytest.raises(quality.DuplicateKeyError, match="already stored.*2024-01-31, a"):
        store.append(PANEL, rows)
    assert store.table(PANEL).select("close").collect() == [(1.0,)]


@pytest.mark.parametrize("name, times", [
    ("daily_update", 1), ("daily_update_realtime", 1), ("table_migration", 1), ("view_after_carry", 1),
    ("append_checked", 2)])
def test_a_query_derives_its_input_once(spark, tmp_path, monkeypatch, name, times):
    plain, folder = adapter.read, str(tmp_path)

    def counted(session, sf_dir, table):
        def made(batches):
            with open(f"{folder}/{uuid.uuid4().hex}", "w"):
                yield from batches

        rows = plain(session, sf_dir, table)
        return rows.coalesce(1).mapInArrow(made, rows.schema) if table == "lineitem" else rows

    monkeypatch.setattr(adapter, "read", counted)
    assert driver.QUERIES[name](spark, SMALL).count() > 0
    assert len(os.listdir(folder)) == times
