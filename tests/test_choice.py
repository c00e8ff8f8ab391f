"""Choosing sources from folders, and reports over columns and pages."""

import os

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import quality
from tapeloom.operators.keys import best_sources
from tapeloom.plans import daily, review
from tapeloom.sources import raw_files

DAYS = ["2024-01-05", "2024-01-08", "2024-01-09"]


def land(spark, path, source, days, close):
    columns = ("`ts_code` string, `trade_date` string, `close` string" if source == "tushare"
               else "`代码` string, `trade_date` string, `最新价` string")
    rows = [(f"00000{i}", day.replace("-", "") if source == "tushare" else day, str(close + i))
            for day in days for i in (1, 2)]
    df = spark.createDataFrame(rows, columns).withColumn("source", F.lit(source))
    raw_files.write_raw(df, path)


def closes(df):
    return sorted((str(r.trade_date), r.ticker, r.close) for r in df.collect())


def test_only_the_best_source_of_each_day_is_read(spark, tmp_path):
    path = str(tmp_path / "raw")
    land(spark, path, "tushare", DAYS[:1], 10)
    land(spark, path, "sina", DAYS[:2], 20)
    land(spark, path, "em", DAYS, 30)
    found = best_sources(raw_files.landed_days(spark, path)).collect()
    assert {(str(r.trade_date), r.source) for r in found} == set(zip(DAYS, ["tushare", "sina", "em"], strict=True))
    for day, source in ((DAYS[0], "sina"), (DAYS[0], "em"), (DAYS[1], "em")):  # these are not to be opened
        folder = f"{path}/year=2024/day={day}/source={source}"
        for name in os.listdir(folder):
            if name.startswith("part-"):
                os.remove(f"{folder}/.{name}.crc")
                with open(f"{folder}/{name}", "w") as out:
                    out.write("other,headers\n1,2\n")
    cleaned = daily.clean_landing(spark, path, [F.lit(0)])
    want = [(d, f"00000{i}", c + i) for d, c in zip(DAYS, (10.0, 20.0, 30.0), strict=True) for i in (1, 2)]
    assert closes(cleaned.select("trade_date", "ticker", "close")) == want
    os.makedirs(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        daily.clean_landing(spark, str(tmp_path / "none"), [F.lit(0)])


def test_unknown_sources_rank_alike(spark):
    sent = spark.createDataFrame([(DAYS[0], "x"), (DAYS[0], "y"), (DAYS[1], "x"), (DAYS[1], "em")], "d string, source string")
    got = best_sources(sent.select(F.col("d").cast("date").alias("trade_date"), "source")).collect()
    assert {(str(r.trade_date), r.source) for r in got} == {(DAYS[0], "x"), (DAYS[0], "y"), (DAYS[1], "em")}


def test_column_report(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "b int, x string, a string")
    got = {tuple(r) for r in quality.column_report(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "misplaced", 1, 3, 1), ("b", "misplaced", 2, 1, 2), ("c", "missing", 3, None, 0), ("x", "extra", None, 2, 0)}
    assert {r.rule for r in quality.column_report(df, df.columns).collect()} == {"ok"}
    assert quality.column_report(df.limit(0), ["b"]).where("n_values > 0").count() == 0


def panel(spark):
    rows = [(DAYS[0], "600001.SH", 10.0, 11.0, 5.0), (DAYS[0], "600002.SH", 10.0, 11.0, 9.0), (DAYS[0], "600003.SH", 10.0, 9.0, 1.0),
            (DAYS[1], "600001.SH", 11.0, 12.1, None), (DAYS[1], "600002.SH", 11.0, 11.0, 2.0), (DAYS[1], "600003.SH", None, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "d string, ticker string, pre_close double, close double, amount double")
    return df.select(F.col("d").cast("date").alias("trade_date"), "ticker", "pre_close", "close", "amount", F.lit("n").alias("name"),
                     F.col("close").alias("high"), ((F.col("close") - F.col("pre_close")) / F.col("pre_close") * 100).alias("pct_change"))


def test_a_dashboard_row_holds_what_the_tables_hold(spark):
    view = review.market_view(panel(spark))
    themes = spark.createDataFrame([(DAYS[0], "600002", "chips"), (DAYS[1], "600009", "other")], "d string, code string, theme string")
    themes = themes.select(F.col("d").cast("date").alias("trade_date"), "code", "theme")
    phases = spark.createDataFrame([(DAYS[0], "rise", None, None)], "d string, phase string, notes string, created_at timestamp").select(
        F.col("d").cast("date").alias("trade_date"), "phase", "notes", "created_at")
    tables = review.dashboard(view, phases, themes, k=2)
    days = {str(r.trade_date): r for r in review.dashboard_days(view, phases, themes, k=2).collect()}
    for kpis in tables["kpis"].collect():
        assert all(days[str(kpis.trade_date)][c] == kpis[c] for c in kpis.__fields__)
    for name, table in (("limit_up_pool", "limit_up_pool"), ("limit_down_pool", "limit_down_pool"), ("losers", "big_losers")):
        want = {day: [] for day in days}
        for r in tables[table].collect():
            want[str(r.trade_date)].append(tuple(r[c] for c in r.__fields__ if c not in ("trade_date", "loser_rank")))
        assert {day: [tuple(x) for x in r[name]] for day, r in days.items()} == want, name
    plan = review.dashboard_days(view, phases, themes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 3 and plan.count("ObjectHashAggregate") >= 1
    bare = review.dashboard_days(view).collect()
    assert {x.theme for r in bare for x in r.limit_up_pool} == {None} and "phase" not in bare[0].__fields__


def test_a_dashboard_gathers_no_whole_day(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 4000, 1, 4).select(
        F.lit("2024-01-02").cast("date").alias("trade_date"), F.format_string("60%04d.SH", "id").alias("ticker"),
        F.lit("n").alias("name"), (F.col("id") % 1000 / 100).alias("pct_change"), F.lit(1.0).alias("amount"),
        F.lit(False).alias("is_limit_up"), F.lit(False).alias("is_limit_down"),
        F.lit(False).alias("is_broken_limit"), F.lit(0).alias("boards"))
    days = review.dashboard_days(rows, k=3)
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan and "slice(" not in plan  # ranked as rows, not cut from an array of all
    assert [r.ts_code for r in days.first().losers] == ["600000.SH", "601000.SH", "602000.SH"]
