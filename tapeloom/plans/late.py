"""Late and corrected days: only what follows from them is rewritten.

A stored panel is each real row and its copies up to the ticker's next real row. A row
delivered for an earlier day changes the copies between that day and the ticker's next real
row, and nothing else; a day that was not stored adds one copy for every other ticker.
So for each changed (day, ticker) the next real row bounds an interval, and the
intervals of a delivery, which never overlap, are filled anew in one job. The result is the
full fill of all real rows, in whatever order they came.

Read are the real rows from the first delivered day on, the days before new ones, and the
partitions to be rewritten. Dates and counts reach the driver, one for each day.
"""

from __future__ import annotations

from bisect import bisect_left
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import get_table
from ..operators import calendar as cal
from ..operators import carry, quality
from ..operators.keys import PANEL_KEY, with_keys_not_in
from ..operators.shaping import conform
from ..sources.store import MARK, PANEL, Store
from .daily import derive

KEY = list(PANEL_KEY)


def _calendar(batch: DataFrame, every: list[date], known: set[date], fresh: set[date]) -> DataFrame:
    """Every stored or delivered day: trade_date, day_no, last_no, is_sent, is_new and the stored day before."""
    rows, before = [], None
    for number, day in enumerate(every, 1):
        rows.append((day, number, len(every), day in fresh, day not in known, before))
        if day in known:
            before = day
    return batch.sparkSession.createDataFrame(
        rows, "trade_date date, day_no int, last_no int, is_sent boolean, is_new boolean, before date")


def _intervals(batch: DataFrame, real: DataFrame, days: DataFrame, replace: bool) -> DataFrame:
    """The batch's rows that change something, with day_no and _until of the interval each
    fills, and has_row, which is false where a row was removed.

    ``real`` has the stored real rows from the first delivered day on. Both sides go to their
    ticker once; there a sent row lies next to the stored one of its key, and a row's interval
    ends at the next real row. A removed row inside another interval is part of that one. A key
    sent twice stops the job.
    """
    values = [c for c in batch.columns if c not in (*KEY, "created_at", MARK)]
    own = F.struct(*values)
    old = real.select(*KEY, own.alias("_held"), F.lit(False).alias("_sent"))
    rows = batch.withColumn("_sent", F.lit(True)).unionByName(old, allowMissingColumns=True)
    rows = rows.join(F.broadcast(days.select("trade_date", "day_no", "last_no", "is_sent")), "trade_date")
    rows = rows.withColumn("_held", F.when(F.col("is_sent"), F.col("_held")))  # compared on delivered days alone
    line = Window.partitionBy("ticker").orderBy("day_no", "_sent")
    led = rows.withColumns({
        "_paired": F.coalesce(F.lag("day_no").over(line) == F.col("day_no"), F.lit(False)),
        "_twice": F.coalesce(F.lag("_sent").over(line), F.lit(False)),
        "_was": F.lag("_held").over(line),
        "_next": F.lead("day_no").over(line),
    })
    led = quality.with_single_key(led, F.col("_paired") & F.col("_twice"), "repeated", KEY)
    changed = F.col("_sent") & ~(F.col("_paired") & own.eqNullSafe(F.col("_was")))
    if not replace:  # each row is a real one as it will be, so the next one ends an interval
        until = F.coalesce("_next", F.col("last_no") + 1)
        return led.where(changed).select(
            *batch.columns, "day_no", until.alias("_until"), F.lit(True).alias("has_row"))
    removed = ~F.col("_sent") & F.col("is_sent") & ~F.coalesce(F.col("_next") == F.col("day_no"), F.lit(False))
    led = led.withColumns({"has_row": ~removed, "_anchor": changed | removed})
    following = F.min(F.when(F.col("has_row"), F.col("day_no"))).over(
        line.rowsBetween(1, Window.unboundedFollowing))
    led = led.withColumns({
        "_until": F.coalesce(following, F.col("last_no") + 1),
        "_inside": ~F.col("has_row") & F.coalesce(F.lag("_anchor").over(line), F.lit(False)),
    })
    return led.where("_anchor and not _inside").select(*batch.columns, "day_no", "_until", "has_row")


def _covered(intervals: DataFrame, every: list[date]) -> dict[date, int]:
    """The days that intervals cover and by how many, from their ends alone: two rows a day."""
    ends = F.array(
        F.struct(F.col("day_no").alias("at"), F.lit(1).alias("n")),
        F.struct(F.col("_until").alias("at"), F.lit(-1).alias("n")))
    steps = intervals.select(F.explode(ends).alias("e")).groupBy("e.at").agg(F.sum("e.n").alias("n")).collect()
    steps, open_now, found = {row["at"]: row["n"] for row in steps}, 0, {}
    for number, day in enumerate(every, 1):
        open_now += steps.get(number, 0)
        if open_now:
            found[day] = open_now
    return found


def refill_days(cleaned: DataFrame, store: Store, replace: bool = False) -> list[date]:
    """Take in rows of any days, stored or not, and refill what follows from them.

    A delivered row wins over the stored one of its key; with ``replace`` a delivered day's
    other real rows go too. Rows equal to stored ones change nothing. Returns the days
    rewritten. The store must have been filled without ``max_gap``.
    """
    contract = get_table(PANEL)
    batch = conform(derive(conform(cleaned, contract, typed=True)), contract, typed=True)
    with store.staged_batch(batch) as (batch, fresh):
        if not fresh:
            return []
        known = {row.trade_date for row in store.days().collect()}
        every = sorted(known.union(fresh))
        days = _calendar(batch, every, known, set(fresh))
        stored = store.table(PANEL, fresh[0], marked=True).withColumn(MARK, F.coalesce(MARK, F.lit(False)))
        with store.kept(_intervals(batch, stored.where(~F.col(MARK)), days, replace)) as intervals:
            return _fill(store, batch.columns, days, intervals, every, known, fresh, replace)


def _fill(
    store: Store, names: list[str], days: DataFrame, intervals: DataFrame, every: list[date],
    known: set[date], fresh: list[date], replace: bool,
) -> list[date]:
    numbers = days.select("trade_date", "day_no", "before", "is_new")
    new = [day for day in fresh if day not in known]
    covered = _covered(intervals, every)
    touched = sorted(set(covered).union(new))
    if not touched:
        return []

    rows = carry.spread_until(intervals.where("has_row"), numbers).select(*names, MARK)

    # before a removed row, and on a new day, the stored row of the day before goes on
    before = F.broadcast(numbers.withColumnRenamed("trade_date", "_day"))
    stored = store.table(PANEL, marked=True).withColumn(MARK, F.coalesce(MARK, F.lit(False)))
    earlier = stored.withColumnRenamed("trade_date", "before")
    copies = None
    if new:
        opened = before.where("is_new and before is not null").select("before", F.col("_day").alias("trade_date"))
        line = sorted(known)
        last = sorted({line[bisect_left(line, one) - 1] for one in new if bisect_left(line, one)})
        if last:
            held = store.table(PANEL, last[0], last[-1], marked=True).withColumn(MARK, F.coalesce(MARK, F.lit(False)))
            held = held.withColumnRenamed("trade_date", "before").where(F.col("before").isin(last))
            copies = held.join(opened, "before").withColumn(MARK, F.lit(True))
            copies = carry.silenced(copies, F.lit(True)).select(*names, MARK)
    if not replace:  # each cell has a row that takes the place of a stored one or of a copy
        store.patch(rows, None, touched, sent=covered, below=copies)
        return touched

    # only a removed row leaves an interval without a row of its own
    cells = carry.spread_until(intervals.select(*KEY, "day_no", "_until"), numbers).select(*KEY)
    gaps = intervals.where("not has_row").select("ticker", "day_no", "_until").join(
        before.select("day_no", "before"), "day_no")
    carried = earlier.join(gaps, ["ticker", "before"]).withColumn("trade_date", F.col("before"))
    carried = carry.silenced(
        carry.spread_until(carried, numbers).withColumn(MARK, F.lit(True)), F.lit(True))
    rows = rows.unionByName(carried.select(*names, MARK))
    if copies is not None:
        rows = rows.unionByName(with_keys_not_in(copies, cells))
    store.patch(rows, cells, touched, may_empty=True)
    return touched
