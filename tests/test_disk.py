"""What writes leave on disk, intervals of late days from their ends alone, rows read once."""

import os
import random
import uuid
from datetime import date, timedelta

from pyspark.sql import functions as F

from tapeloom.operators import carry
from tapeloom.plans import late
from tapeloom.session import shared_dir
from tapeloom.sources import store as stores
from tapeloom.sources.store import PANEL, Store

START = date(2024, 1, 1)


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def new_store(spark):
    store = Store(spark, f"disk_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), "month")
    store.create_tables()
    return store


def test_shuffle_files_go_when_a_write_ends(spark):
    store = new_store(spark)
    rows = spark.range(20000).select(
        F.date_add(F.lit(START), (F.col("id") % 40).cast("int")).alias("trade_date"),
        F.sha2(F.floor(F.col("id") / 40).cast("string"), 256).alias("ticker"), F.rand(1).alias("close"))
    before = shuffled_bytes(spark)
    store.replace_days(rows)
    late.refill_days(rows.withColumn("close", F.rand(2)), store)
    store.upsert(rows.withColumn("close", F.rand(3)))
    assert store.table(PANEL).count() == 20000
    assert shuffled_bytes(spark) - before < 200_000  # each row holds a ticker of 64 letters: 1.3 MB


def test_a_large_write_is_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(stores, "_SHARE_ROWS", 10)
    store, rows = new_store(spark), spark.range(500).selectExpr(
        "date'2024-01-01' AS trade_date", "cast(id AS string) AS ticker", "1.0D AS close")
    dealt = store._dealt(store._slice(PANEL, []), store._ready(rows, PANEL))
    assert dealt.rdd.getNumPartitions() == 100 and dealt.where("_last").count() == 500


def test_days_that_intervals_cover_are_counted_without_filling_them(spark):
    draw, every = random.Random(5), [START + timedelta(days=n) for n in range(30)]
    ends = [(no, draw.randint(no + 1, min(no + 6, 31))) for no in (draw.randint(1, 25) for _ in range(40))]
    intervals = spark.createDataFrame(ends, "day_no int, _until int")
    days = spark.createDataFrame(list(enumerate(every, 1)), "day_no int, trade_date date")
    filled = carry.spread_until(intervals, days).groupBy("trade_date").count()
    assert late._covered(intervals, every) == {r.trade_date: r["count"] for r in filled.collect()}


def counted(rows, folder):
    """``rows`` that leave a file for each time they are read."""
    os.makedirs(folder)

    def made(batches):
        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            yield from batches

    return rows.coalesce(1).mapInArrow(made, rows.schema)


def test_a_refill_reads_its_rows_once(spark, tmp_path):
    store = new_store(spark)
    rows = spark.createDataFrame(
        [(START, "600000.SH", 1.0), (START + timedelta(days=1), "000001.SZ", 2.0)],
        "trade_date date, ticker string, close double")
    late.refill_days(rows, store)
    late.refill_days(counted(rows.withColumn("close", F.col("close") + 1), str(tmp_path / "reads")), store)
    assert len(os.listdir(tmp_path / "reads")) == 1
    held = store.snapshot().select("ticker", "close", "is_carried").collect()
    assert sorted(map(tuple, held)) == [
        ("000001.SZ", 3.0, False), ("600000.SH", 2.0, False), ("600000.SH", 2.0, True)]


def test_copies_are_stored_beside_their_row(spark):
    store, days = new_store(spark), [START + timedelta(days=n) for n in range(20)]
    rows = spark.createDataFrame(
        [(d, f"{n}", float(n)) for d in days for n in range(9)], "trade_date date, ticker string, close double")
    want = sorted((f"{n}", d) for d in days for n in range(9))
    for write in (store.replace_days, store.upsert, lambda df: late.refill_days(df.withColumn("close", F.lit(0.5)), store)):
        write(rows)
        held = spark.table(store.name(PANEL)).withColumn("at", F.monotonically_increasing_id())
        assert [(r.ticker, r.trade_date) for r in held.orderBy("at").collect()] == want
