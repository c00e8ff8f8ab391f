"""Rows are shuffled once for a merge, its key checks and the write, and once for a panel."""

import uuid
from datetime import date

import pytest

from tapeloom.driver import QUERIES, adapter
from tapeloom.operators import quality
from tapeloom.session import settings, shared_dir
from tapeloom.sources import store as stores
from tapeloom.sources.store import PANEL, Store
from tapeloom.streaming import landing

SMALL = "/root/testdata/sf0.001"
SCHEMA = "trade_date date, ticker string, name string, close double, created_at timestamp"


@pytest.mark.parametrize("grain, share", [("day", 1), ("month", 1), ("month", 1000)])
def test_a_merge_its_checks_and_the_write_share_a_shuffle(spark, monkeypatch, grain, share):
    def apart(*args):
        raise AssertionError("keys were shuffled apart from the rows")

    monkeypatch.setattr(quality, "require_new_keys", apart)
    monkeypatch.setattr(stores, "_SHARE_ROWS", share)
    store = Store(spark, f"once_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), grain)
    store.create_tables()
    days = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1)]

    def rows(some, close, made="2024-02-02"):
        made = f"timestamp'{made}'"
        return spark.createDataFrame(
            [(d, t, close) for d, t in some], "trade_date date, ticker string, close double"
        ).selectExpr("trade_date", "ticker", "if(ticker = 'a', null, 'n') AS name", "close", f"{made} AS created_at")

    def held():
        found = store.table(PANEL).selectExpr("trade_date", "ticker", "close", "year(created_at)")
        return sorted(tuple(r) for r in found.collect())

    store.append(PANEL, rows([(days[0], "a"), (days[0], "b"), (days[2], "a")], 1.0, "2000-01-01"))
    store.append(PANEL, rows([(days[1], "a")], 1.0, "2000-01-01"))
    store.upsert(rows([(days[0], "a"), (days[1], "b"), (days[2], "a")], 2.0))
    assert held() == [
        (days[0], "a", 2.0, 2000), (days[0], "b", 1.0, 2000), (days[1], "a", 1.0, 2000),
        (days[1], "b", 2.0, 2024), (days[2], "a", 2.0, 2000)]
    store.replace_by_key(PANEL, rows([(days[0], "b"), (days[2], "c")], 3.0))
    before = held()
    assert before == [
        (days[0], "a", 2.0, 2000), (days[0], "b", 3.0, 2024), (days[1], "a", 1.0, 2000),
        (days[1], "b", 2.0, 2024), (days[2], "a", 2.0, 2000), (days[2], "c", 3.0, 2024)]
    for write, message in (
        (lambda df: store.append(PANEL, df), "already stored"), (store.upsert, None),
    ):
        if message:
            with pytest.raises(quality.DuplicateKeyError, match=message):
                write(rows([(days[1], "b"), (days[1], "z")], 9.0))
        with pytest.raises(quality.DuplicateKeyError, match="repeated"):
            write(rows([(days[1], "y"), (days[1], "z"), (days[1], "y")], 9.0))
    assert held() == before


def test_a_panel_takes_one_shuffle_of_lines(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = adapter.panel(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2  # lines and names


def test_landed_files_of_the_shuffled_days_do_not_grow_in_number(spark, monkeypatch):
    def counted(session, path, columns, max_files=None, glob=None):
        found = session.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        raise LookupError(f"{found.count()} files, {max_files} at a time")

    monkeypatch.setattr(landing, "read_landing", counted)
    with settings(spark, spark__sql__files__maxPartitionBytes="64k", spark__sql__files__openCostInBytes="1k"):
        with pytest.raises(LookupError, match="^16 files, 2 at a time"):
            QUERIES["stream_shuffled_days"](spark, SMALL)
