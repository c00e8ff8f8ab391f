"""Sums of doubles in whole parts."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import numbers
from tapeloom.operators import series


def test_averages_are_exact_whatever_the_order_of_size(spark):
    draw = random.Random(1)
    rows = [(f"t{t}", i, draw.choice([1e9, 1.0, 0.01, -7.0, 1e5 / 3]) * draw.random() + 1) for t in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "ticker string, n int, close double").withColumn(
        "trade_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")))
    got = {(r.ticker, r.n): (r.ma3, r.ma250) for r in series.moving_averages(df, (3, 250)).collect()}
    values = {(t, i): Fraction(x) for t, i, x in rows}
    for (t, i), found in got.items():
        for n, average in zip((3, 250), found, strict=True):
            want = None if i + 1 < n else sum(values[t, j] for j in range(i - n + 1, i + 1)) / n
            if want is None:
                assert average is None
            else:
                assert average == pytest.approx(float(want), rel=3e-16)
                if abs(average - float(want)) > 0:  # at most the last of two roundings
                    assert abs(Fraction(average) - want) <= Fraction(abs(average)) / 2**51


def test_limbs_hold_what_they_are_made_of(spark):
    some = [0.0, -0.0, 0.1, -0.1, 1 / 3, 2.0**-9 + 2.0**-61, 123456789.987654321, -2.5, 2.0**40 + 2.0**-12, 1e15 + 0.5, None]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    whole, upper, lower = numbers.limbs(F.col("x"))
    back = df.select("x", numbers.from_limbs(whole, upper, lower).alias("y")).collect()
    assert all(r.x == r.y for r in back)
    parts = df.select("x", whole.alias("a"), upper.alias("b"), lower.alias("c")).where("x is not null").collect()
    assert all(Fraction(r.x) == r.a + Fraction(r.b, 2**31) + Fraction(r.c, 2**62) for r in parts)


def test_work_per_row_does_not_grow_with_the_length(spark):
    df = spark.range(10).select(
        F.lit("t").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"),
        F.col("id").cast("double").alias("close"))
    plans = [series.moving_averages(df, (n,))._jdf.queryExecution().optimizedPlan().toString() for n in (5, 250)]
    assert all("unboundedpreceding" in p and "-249" not in p and "-4," not in p for p in plans)
    assert plans[0].count("windowspecdefinition") == plans[1].count("windowspecdefinition")


def test_missing_values_leave_averages_out(spark):
    rows = [(i, None if i == 3 else float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, close double").select(
        F.lit("t").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), "i").alias("trade_date"), "close")
    got = [r.ma3 for r in series.moving_averages(df, (3,)).orderBy("trade_date").collect()]
    assert got == [None, None, 1.0, None, None, None, 5.0, 6.0]
