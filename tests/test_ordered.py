"""Landing in any order: batches, holding, restarts, and what the logs say."""

import os
import random
import time
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import quality
from tapeloom.session import shared_dir
from tapeloom.sources import raw_files
from tapeloom.sources.store import PANEL, Store
from tapeloom.streaming import landing, ordered

HEADER = ["trade_date", "代码", "名称", "最新价", "成交量"]
START = date(2024, 1, 27)


@pytest.fixture(params=["day", "month"])
def store(spark, request):
    made = Store(spark, f"ord_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), request.param)
    made.create_tables()
    return made


def land(folder, name, rows):
    text = [",".join(HEADER)] + [f"{START + timedelta(days=n)},{code},x,{close},7" for n, code, close in rows]
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write("\n".join(text) + "\n")
    land.clock = getattr(land, "clock", time.time() - 10_000) + 10  # later files have later times
    os.utime(path, (land.clock, land.clock))


def run(spark, store, folder, hold, max_files=1):
    stream = landing.read_landing(spark, folder, HEADER, max_files=max_files)
    query = ordered.ingest_in_order(stream, store, "em", f"{folder}/../checkpoint", hold)
    query.awaitTermination()
    return ordered.OrderedLanding(store, hold)


def filled(real):
    days, out = sorted({n for n, _ in real}), set()
    for code in {c for _, c in real}:
        last = None
        for n in days:
            last = real.get((n, code), last)
            if last is not None:
                out.add((START + timedelta(days=n), code, last, (n, code) not in real))
    return out


def held(store):
    rows = store.snapshot().select("trade_date", F.substring("ticker", 1, 6), "close", "is_carried").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


@pytest.mark.parametrize("hold", [0, 3])
def test_any_arrival_equals_the_batch_load(spark, store, tmp_path, hold):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    draw = random.Random(3)
    real = {(n, code): float(draw.randint(1, 9)) for n in range(9) for code in ("000001", "600000", "300001")
            if draw.random() < 0.6}
    shares = [[], [], [], []]
    for (n, code), close in real.items():
        draw.choice(shares).append((n, code, close))
    for i, share in enumerate(shares[:3]):
        land(folder, f"{9 - i}.csv", share)
    run(spark, store, folder, hold)
    land(folder, "0.csv", shares[3])  # a restart from the checkpoint sees one file
    own = run(spark, store, folder, hold)
    if hold:
        assert own.pending() and held(store) != filled(real)
    own.finish()
    assert own.pending() == {} and held(store) == filled(real)
    assert own.finish() == []
    report = own.report(raw_files.list_files(spark, folder, "*.csv")).collect()
    assert {os.path.basename(r.path): (r.outcome, r.n_rows) for r in report} == {
        name: ("taken", len(share)) for name, share in zip(["9.csv", "8.csv", "7.csv", "0.csv"], shares)}


def test_a_repeated_batch_and_a_repeated_admission_change_nothing(spark, store, tmp_path):
    own = ordered.OrderedLanding(store)
    rows = spark.createDataFrame(
        [(START, "600000.SH", 1.0, "a"), (START + timedelta(days=1), "000001.SZ", 2.0, "b")],
        "trade_date date, ticker string, close double, file_path string")
    from tapeloom.contracts import DAILY_MARKET_SNAPSHOT
    from tapeloom.operators.shaping import conform
    whole = conform(rows, DAILY_MARKET_SNAPSHOT, typed=True, keep=["file_path"])
    for _ in range(2):  # the second time the job died after keep
        own.keep(whole, 0)
    assert sum(map(len, own.pending().values())) == len({store._period_of(r.trade_date) for r in rows.collect()})
    assert len(own.admit(0)) == 2
    before = held(store)
    own.keep(whole, 0)  # or after the panel was written
    assert own.admit(0) == [] and own.pending() == {}
    assert held(store) == before
    assert spark.table(store.name(ordered.FILES)).count() == 2
    days = spark.table(store.name(ordered.DAYS)).orderBy("trade_date").collect()
    assert [(r.n_rows, r.is_late, r.batch) for r in days] == [(1, False, 0), (1, False, 0)]


def test_late_days_corrections_and_failed_files_are_told(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    land(folder, "a.csv", [(0, "600000", 1.0), (40, "600000", 2.0)])
    land(folder, "b.csv", [(3, "600000", 5.0), (0, "600000", 9.0)])
    land(folder, "c.csv", [])
    own = run(spark, store, folder, 0)
    assert held(store) == filled({(0, "600000"): 9.0, (3, "600000"): 5.0, (40, "600000"): 2.0})
    late = [(r.trade_date - START).days for r in spark.table(store.name(ordered.DAYS)).where("is_late").collect()]
    assert sorted(late) == [0, 3]
    outcome = {os.path.basename(r.path): r.outcome for r in own.report(raw_files.list_files(spark, folder, "*.csv")).collect()}
    assert outcome == {"a.csv": "taken", "b.csv": "taken", "c.csv": "failed"}


def test_rows_without_a_date_stop_the_stream_before_the_store(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as out:
        out.write(",".join(HEADER) + "\nnever,600000,x,1,1\n")
    with pytest.raises(Exception, match="without a date"):
        run(spark, store, folder, 0)
    assert store.table(PANEL).count() == 0
