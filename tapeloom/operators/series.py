"""Per-ticker series: previous close, changes, moving averages, board streaks.

All windows here share one specification, so one shuffle on ``ticker`` and one
sort serve them all. A panel's key is (trade_date, ticker): a ticker has at
most one row per trading day, so no series outgrows the calendar. Feed these
operators keyed panels (``keep_last`` or the checked store), not raw deliveries.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..contracts import fixed_values as fixed
from ..functions import limits, numbers


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("trade_date")


def so_far() -> WindowSpec:
    return by_ticker().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def previous_close(df: DataFrame, name: str = "pre_close") -> DataFrame:
    return df.withColumn(name, F.lag("close").over(by_ticker()))


def derive_changes(
    df: DataFrame, start: date | str | None = None, drop_first: bool = True
) -> DataFrame:
    """Previous close and percent change from a bare series.

    ``start`` cuts the series before the lag, so its first row has no previous
    close and is dropped with ``drop_first``.
    """
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start).cast("date"))
    df = previous_close(df)
    if drop_first:
        df = df.dropna(subset=["pre_close"])
    return df.withColumn("pct_change", limits.change_pct(F.col("close"), F.col("pre_close")))


def moving_averages(
    df: DataFrame,
    lengths: Sequence[int] = fixed.MOVING_AVERAGE_LENGTHS,
    value: str = "close",
    places: int | None = None,
    prefix: str = "ma",
) -> DataFrame:
    """Add ``ma{n}`` for each length: the mean of the last n rows, NULL before n
    values exist.

    Every length is the difference of two running sums: constant work per row, whatever
    n is. Doubles are summed exactly in three whole parts (``numbers.limbs``) and rounded
    once at the end. With ``places``, for values known to carry no more decimals, one sum
    of whole numbers does.
    """
    if places is None:
        parts = dict(zip(("_whole", "_upper", "_lower"), numbers.limbs(F.col(value).cast("double"))))
    else:
        parts = {"_sum": numbers.scaled(F.col(value), places)}
    running = df.withColumns(
        {
            **{c: F.coalesce(F.sum(part).over(so_far()), F.lit(0)) for c, part in parts.items()},
            "_seen": F.count(value).over(so_far()),
        }
    )

    def average(n: int) -> Column:
        sums = [F.col(c) - F.lag(c, n, 0).over(by_ticker()) for c in parts]
        seen = F.col("_seen") - F.lag("_seen", n, 0).over(by_ticker())
        if places is None:
            return F.when(seen == n, numbers.from_limbs(*sums) / F.lit(float(n)))
        return F.when(seen == n, sums[0] / F.lit(float(n * 10**places)))

    return running.withColumns({f"{prefix}{n}": average(n) for n in lengths}).drop(*parts, "_seen")


def board_streak(df: DataFrame, flag: str = "is_limit_up", name: str = "boards") -> DataFrame:
    """Consecutive limit-up rows up to and with this one; 0 on other rows.

    The streak is the row's number less the number of the last row without a
    limit-up, which needs no second grouping by island.
    """
    numbered = df.withColumn("_row", F.row_number().over(by_ticker()))
    last_break = F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("_row"))).over(so_far())
    return numbered.withColumn(
        name,
        F.when(F.col(flag), F.col("_row") - F.coalesce(last_break, F.lit(0))).otherwise(0),
    ).drop("_row")
