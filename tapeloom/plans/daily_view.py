"""The review view of a day from the state of the day before.

States are stored by day. A day's view reads that state and the day's own rows; the history
is read once, to start. After a correction the states from the first changed day on are
dropped and folded again from the last good one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import fixed_values as fixed
from ..operators import running
from ..session import writing_folders
from ..sources.store import PANEL, Store
from .review import flagged_view, market_view

STATES = "series_state"


class DailyView:
    """Views and states over one store; ``depth`` bounds the averages' lengths."""

    def __init__(self, store: Store, depth: int = max(fixed.MOVING_AVERAGE_LENGTHS)):
        self.store, self.depth = store, depth
        store.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {store.name(STATES)} (ticker string, last_date date,"
            " closes array<double>, boards int, trade_date date) USING parquet PARTITIONED BY (trade_date)")

    def days(self) -> list[date]:
        """Days that have a state, from the catalog."""
        parts = self.store.spark.sql(f"SHOW PARTITIONS {self.store.name(STATES)}").collect()
        return sorted(date.fromisoformat(row.partition.partition("=")[2]) for row in parts)

    def state(self, day: date) -> DataFrame:
        held = self.store.spark.table(self.store.name(STATES))
        return held.where(F.col("trade_date") == F.lit(day)).select(*running.STATE_COLUMNS)

    def _write(self, state: DataFrame, day: date) -> None:
        rows = state.select(*running.STATE_COLUMNS, F.lit(day).alias("trade_date"))
        with writing_folders(rows.sparkSession):
            rows.write.insertInto(self.store.name(STATES), overwrite=True)

    def _rows(self, first: date | None, last: date) -> DataFrame:
        """Real rows with limit flags of the days from first to last."""
        return flagged_view(self.store.table(PANEL, first, last, marked=True))

    def _before(self, day: date) -> date | None:
        """The last day before ``day`` that has a state."""
        return max((d for d in self.days() if d < day), default=None)

    def start(self, day: date) -> None:
        """Make the state of ``day`` from the whole history up to it."""
        view = market_view(self.store.table(PANEL, None, day, marked=True))
        self._write(running.state_of_history(view, self.depth), day)

    def advance(self, day: date) -> None:
        """Make the state of ``day`` from the last one before it and the days between."""
        before = self._before(day)
        if before is None:
            self.start(day)
            return
        rows = self._rows(before, day).where(F.col("trade_date") > F.lit(before))
        self._write(running.fold(self.state(before), rows, self.depth), day)

    def view(
        self,
        day: date,
        lengths: Sequence[int] = fixed.MOVING_AVERAGE_LENGTHS,
        places: int | None = None,
    ) -> DataFrame:
        """The day's rows with flags, last_close, boards and averages.

        The state of the stored day before is made first where it is missing.
        """
        if max(lengths) > self.depth + 1:
            raise ValueError(f"averages of {max(lengths)} rows need a depth of {max(lengths) - 1}")
        rows = self._rows(day, day)
        before = self.store.previous_trade_date(day)
        if before is None:
            empty = self.store.spark.table(self.store.name(STATES)).where(F.lit(False))
            return running.day_from_state(empty, rows, lengths, places)
        if before not in self.days():
            self.advance(before)
        return running.day_from_state(self.state(before), rows, lengths, places)

    def forget(self, changed: Sequence[date]) -> None:
        """Drop the states that rows of the changed days have gone into."""
        gone = [day for day in self.days() if changed and day >= min(changed)]
        if gone:
            parts = ", ".join(f"PARTITION (trade_date = '{day}')" for day in gone)
            self.store.spark.sql(f"ALTER TABLE {self.store.name(STATES)} DROP {parts}")
