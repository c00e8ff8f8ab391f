"""Series by folding: a ticker's state instead of its history.

A state row has what a series needs from the past: the last closes, newest first, and the
running limit-up streak. States fold forward over the rows of any number of days, so
previous closes, averages and streaks of a new day need one row per ticker besides the
day's own rows, however long the history is. Results equal the windows of ``series``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import fixed_values as fixed
from ..functions import numbers
from .series import by_ticker

STATE_COLUMNS = ("ticker", "last_date", "closes", "boards")


def state_of_history(view: DataFrame, depth: int = max(fixed.MOVING_AVERAGE_LENGTHS)) -> DataFrame:
    """State after all rows of a view with boards: one pass of windows, one row per ticker.

    ``depth`` closes are kept, enough for averages of up to ``depth + 1`` rows.
    """
    recent = by_ticker().rowsBetween(-(depth - 1), 0)
    held = view.select(
        "ticker", "trade_date", "boards",
        # structs, since a list leaves out bare NULLs
        F.collect_list(F.struct("close")).over(recent).alias("tail"),
    )
    last = held.groupBy("ticker").agg(
        F.max("trade_date").alias("last_date"),
        F.max_by(F.struct("tail", "boards"), "trade_date").alias("last"))
    closes = F.reverse(F.transform("last.tail", lambda x: x["close"]))
    return last.select("ticker", "last_date", closes.alias("closes"), F.col("last.boards").cast("int").alias("boards"))


def fold(
    state: DataFrame, rows: DataFrame, depth: int = max(fixed.MOVING_AVERAGE_LENGTHS)
) -> DataFrame:
    """State after ``rows`` (ticker, trade_date, close, is_limit_up), all later than the state.

    A ticker's new rows, at most one for each day folded, meet in one list.
    """
    day = F.struct("trade_date", "close", F.coalesce("is_limit_up", F.lit(False)).alias("up"))
    added = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(day)).alias("new"))
    old = F.coalesce("closes", F.array().cast("array<double>"))
    new = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.array().cast(added.schema["new"].dataType))
    closes = F.slice(F.concat(F.reverse(F.transform(new, lambda x: x["close"])), old), 1, depth)
    boards = F.aggregate(
        new, F.coalesce("boards", F.lit(0)), lambda n, x: F.when(x["up"], n + 1).otherwise(0))
    joined = state.select(*STATE_COLUMNS).join(added, "ticker", "full_outer")
    newest = F.element_at(F.col("new"), -1)["trade_date"]
    return joined.select(
        "ticker", F.coalesce(newest, "last_date").alias("last_date"), closes.alias("closes"), boards.alias("boards"))


_PARTS = ("whole", "upper", "lower")


def _named(*parts: Column) -> Column:
    return F.struct(*[part.alias(c) for part, c in zip(parts, _PARTS)])


def _limbs(value: Column) -> Column:
    return _named(*numbers.limbs(value))


def day_from_state(
    state: DataFrame,
    day: DataFrame,
    lengths: Sequence[int] = fixed.MOVING_AVERAGE_LENGTHS,
    places: int | None = None,
) -> DataFrame:
    """One day's rows (with is_limit_up) beside last_close, boards and ma{n}.

    ``last_close`` is the close of the ticker's row before; NULL at its first. ``places``
    as in ``series.moving_averages``.
    """
    before = state.select("ticker", F.col("closes").alias("_closes"), F.col("boards").alias("_boards"))
    joined = day.join(before, "ticker", "left")
    past = F.coalesce("_closes", F.array().cast("array<double>"))
    line = F.concat(F.array("close"), past)

    def average(n: int) -> Column:
        tail = F.slice(line, 1, n)
        whole = (F.size(tail) == n) & F.forall(tail, lambda x: x.isNotNull())
        if places is None:
            none = F.lit(0).cast("bigint")
            total = F.aggregate(
                F.transform(tail, _limbs), _named(none, none, none),
                lambda a, x: _named(*[a[c] + x[c] for c in _PARTS]))
            return F.when(whole, numbers.from_limbs(*[total[c] for c in _PARTS]) / F.lit(float(n)))
        units = F.aggregate(tail, F.lit(0).cast("bigint"), lambda a, x: a + numbers.scaled(x, places))
        return F.when(whole, units / F.lit(float(n * 10**places)))

    boards = F.when(F.col("is_limit_up"), F.coalesce("_boards", F.lit(0)) + 1).otherwise(0)
    return joined.withColumns({
        "last_close": F.try_element_at(past, F.lit(1)),
        "boards": boards,
        **{f"ma{n}": average(n) for n in lengths},
    }).drop("_closes", "_boards")
