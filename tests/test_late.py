"""Late and corrected days against a plain fill of all real rows."""

import random
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import quality
from tapeloom.plans import late
from tapeloom.session import shared_dir
from tapeloom.sources.store import PANEL, Store

START = date(2024, 1, 20)
SCHEMA = "trade_date date, ticker string, name string, close double, pct_change double, volume long, amount double"


@pytest.fixture(params=["day", "month"])
def store(spark, request):
    made = Store(spark, f"late_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), request.param)
    made.create_tables()
    return made


def day(n):
    return START + timedelta(days=n)


def delivery(spark, real):
    rows = [(day(n), t, f"n{t}", close, 1.0, 5, 2.0) for (n, t), close in sorted(real.items())]
    return spark.createDataFrame(rows, SCHEMA)


def filled(real):
    """Every (day, ticker) from the ticker's first real row on: close, volume and whether it is a copy."""
    days = sorted({n for n, _ in real})
    out = {}
    for t in {t for _, t in real}:
        last = None
        for n in days:
            if (n, t) in real:
                last = real[n, t]
                out[day(n), t] = (last, 5, False)
            elif last is not None:
                out[day(n), t] = (last, 0, True)
    return out


def held(store):
    rows = store.snapshot().select("trade_date", "ticker", "close", "volume", "is_carried", "amount").collect()
    assert all(r.amount == (0.0 if r.is_carried else 2.0) for r in rows)
    assert len({(r.trade_date, r.ticker) for r in rows}) == len(rows)
    return {(r.trade_date, r.ticker): (r.close, r.volume, r.is_carried) for r in rows}


def files(store):
    parts = store.spark.table(store.name(PANEL)).select(F.input_file_name().alias("f")).distinct().collect()
    return {r.f for r in parts}


@pytest.mark.parametrize("replace", [False, True])
def test_deliveries_in_any_order_equal_one_fill(spark, store, replace):
    draw, real = random.Random(7 + replace), {}
    for step in range(5):
        days = draw.sample(range(16), 16 if step == 0 else draw.randint(1, 4))
        days = [n for n in days if step or n % 3 != 1]  # some days are unknown at first
        new = {(n, t): float(draw.randint(1, 9)) for n in days for t in "abcdef" if draw.random() < 0.4}
        if not new:
            continue
        if replace:
            sent = {n for n, _ in new}
            real = {k: v for k, v in real.items() if k[0] not in sent}
        real |= new
        late.refill_days(delivery(spark, new), store, replace)
        assert held(store) == filled(real), step


def test_only_partitions_with_changed_rows_are_rewritten(spark, store):
    real = {(n, t): float(n + 1) for n in range(0, 40, 2) for t in "ab"} | {(0, "c"): 7.0}
    late.refill_days(delivery(spark, real), store)
    before = files(store)
    assert late.refill_days(delivery(spark, {(2, "a"): 3.0, (0, "c"): 7.0}), store) == []
    assert files(store) == before  # equal rows change nothing
    real[4, "a"] = 50.0  # the next real row is on day 6
    assert late.refill_days(delivery(spark, {(4, "a"): 50.0}), store) == [day(4)]
    assert held(store) == filled(real)
    kept = files(store) & before
    assert len(kept) == len(before) - 1
    real[5, "a"] = 51.0  # a day that no one had: one copy for each other ticker
    assert late.refill_days(delivery(spark, {(5, "a"): 51.0}), store) == [day(5)]
    assert held(store) == filled(real)
    real[6, "c"] = 8.0  # goes on to the end
    assert late.refill_days(delivery(spark, {(6, "c"): 8.0}), store) == [day(n) for n in range(6, 40, 2)]
    assert held(store) == filled(real)


def test_removed_rows(spark, store):
    real = {(0, "a"): 1.0, (0, "b"): 2.0, (1, "a"): 3.0, (2, "b"): 4.0, (3, "a"): 5.0}
    late.refill_days(delivery(spark, real), store)
    late.refill_days(delivery(spark, {(0, "b"): 2.5}), store, replace=True)  # a starts a day later
    real = {k: v for k, v in real.items() if k != (0, "a")} | {(0, "b"): 2.5}
    assert held(store) == filled(real)
    late.refill_days(delivery(spark, {(1, "c"): 9.0}), store, replace=True)
    del real[1, "a"]
    assert held(store) == filled(real | {(1, "c"): 9.0})


def test_a_repeated_key_changes_nothing(spark, store):
    real = {(0, "a"): 1.0}
    late.refill_days(delivery(spark, real), store)
    twice = delivery(spark, {(1, "a"): 2.0})
    with pytest.raises(quality.DuplicateKeyError):
        late.refill_days(twice.union(twice), store)
    assert held(store) == filled(real)
    assert late.refill_days(twice.limit(0), store) == []
