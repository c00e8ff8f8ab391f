"""Series folded from states against series over whole histories."""

import random
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import running, series
from tapeloom.plans import daily_view, late, review
from tapeloom.session import shared_dir
from tapeloom.sources.store import PANEL, Store

START = date(2024, 1, 20)
LENGTHS = (2, 3, 5)
WANTED = ["trade_date", "ticker", "close", "last_close", "boards", "ma2", "ma3", "ma5"]


def day(n):
    return START + timedelta(days=n)


def rows(spark, seed=1, n=14):
    draw, out = random.Random(seed), []
    for t in "abcdef":
        for i in range(n):
            if draw.random() < 0.7:
                close = None if draw.random() < 0.1 else round(draw.uniform(1, 9), 3)
                out.append((day(i), t, close, draw.choice([True, True, False, None])))
    return spark.createDataFrame(out, "trade_date date, ticker string, close double, is_limit_up boolean")


def whole(df):
    view = series.board_streak(series.previous_close(df, "last_close"))
    return series.moving_averages(view, LENGTHS)


def values(df, columns=WANTED):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("cuts", [(13,), (0, 5, 13), tuple(range(14))])
def test_folds_over_any_spans_equal_one_pass(spark, cuts):
    df = rows(spark)
    want, first, state = whole(df), None, None
    for cut in cuts:
        span = df.where(F.col("trade_date") <= F.lit(day(cut)))
        if state is None:
            state = running.state_of_history(series.board_streak(span), depth=4)
        else:
            state = running.fold(state, span.where(F.col("trade_date") > F.lit(day(first))), depth=4)
        first = cut
        state = spark.createDataFrame(state.collect(), state.schema)
        after = running.state_of_history(series.board_streak(span), depth=4)
        assert values(state, running.STATE_COLUMNS) == values(after, running.STATE_COLUMNS)
        if cut < 13:
            following = df.where(F.col("trade_date") == F.lit(day(cut + 1)))
            got = running.day_from_state(state, following, LENGTHS)
            assert values(got) == values(want.where(F.col("trade_date") == F.lit(day(cut + 1))))


def panel(spark):
    made = rows(spark, 5, 40).where("close is not null").drop("is_limit_up").withColumn(
        "close", F.round(F.col("close") / 10 + 10, 2))
    made = made.withColumn("ticker", F.concat(F.lit("60000"), F.ascii("ticker") % 10, F.lit(".SH")))
    return series.derive_changes(made, drop_first=False).withColumns({
        "name": F.lit("x"), "high": F.col("close") + 1, **{c: F.lit(1.0) for c in ("open", "low", "volume", "amount")}})


@pytest.fixture(params=["day", "month"])
def store(spark, request):
    made = Store(spark, f"run_{uuid.uuid4().hex[:8]}", shared_dir(spark, "store"), request.param)
    made.create_tables()
    late.refill_days(panel(spark), made)
    return made


def check(own, store, when):
    columns = ["trade_date", "ticker", "close", "boards", "candle_state", "ma2", "ma5"]
    view = series.moving_averages(review.market_view(store.snapshot()), (2, 5)).where(F.col("trade_date") == F.lit(when))
    assert values(own.view(when, (2, 5)), columns) == values(view, columns)


def test_views_of_a_store(spark, store):
    own = daily_view.DailyView(store, depth=4)
    days = sorted(r.trade_date for r in store.days().collect())
    check(own, store, days[0])  # nothing before
    own.start(days[3])
    check(own, store, days[10])  # folds what lies between
    assert own.days() == [days[3], days[9]]
    own.advance(days[10])
    check(own, store, days[11])
    changed = late.refill_days(panel(spark).where(F.col("trade_date") == F.lit(days[7])).withColumn(
        "close", F.col("close") + 1), store)
    own.forget(changed)
    assert own.days() == [days[3]]
    check(own, store, days[11])
    with pytest.raises(ValueError):
        own.view(days[11], (6,))


def test_a_view_reads_the_state_and_the_day_alone(spark, store):
    own = daily_view.DailyView(store, depth=4)
    days = sorted(r.trade_date for r in store.days().collect())
    own.advance(days[20])
    plan = own.view(days[21], (2, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2
    filters = [line.split("PartitionFilters:")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters:" in line]
    assert all("=" in f for f in filters) and any(str(days[20]) in f for f in filters)
    assert "Window" not in plan
