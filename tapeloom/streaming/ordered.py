"""Landing whose days may arrive split, late, corrected or in any order.

A micro-batch is first kept as it came: its rows go to a pending table in the store's grain, its
files to a log. Then what is ripe is admitted, all at once and in date order, by
``plans.late.refill_days``: new days go on from those before them, and earlier days
change only what follows from them. A day (month, year: the grain) is ripe once ``hold`` later
ones have been seen, so that one that arrives in several files is taken in once.

All steps repeat safely. A batch that is run again overwrites its own partitions; a day
that is admitted again brings rows that are stored already, which changes nothing; and pending
rows go only after the store has them. So the panel is the batch load of all files, whatever
order, batches or restarts there were.

Of rows with one key the file last by path wins within the pending rows; a file that
comes after its day was admitted wins over the stored row.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contracts import DAILY_MARKET_SNAPSHOT, layout_of
from ..operators import quality
from ..operators.keys import PANEL_KEY, keep_last
from ..plans import daily, late
from ..session import writing_folders
from ..sources import raw_files
from ..sources.store import Store

PENDING, FILES, DAYS = "landing_pending", "landing_files", "landing_days"
PATH, FOLDER = "file_path", "folder"


class OrderedLanding:
    """Pending rows and logs of one stream, in the store's database.

    ``landing_files`` has file_path, n_rows, first_day, last_day for each batch;
    ``landing_days`` has trade_date, n_rows, is_late for each batch that admitted days. A
    day is late when a later one had been admitted.
    """

    def __init__(self, store: Store, hold: int = 0):
        self.store, self.hold = store, hold
        rows = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}"
            for f in DAILY_MARKET_SNAPSHOT.schema.fields if f.name != "trade_date")
        for table, columns, folders in (
            (PENDING, f"{rows}, {PATH} string, trade_date date, {FOLDER} string, batch bigint", f"{FOLDER}, batch"),
            (FILES, f"{PATH} string, n_rows bigint, first_day date, last_day date, batch bigint", "batch"),
            (DAYS, "trade_date date, n_rows bigint, is_late boolean, batch bigint", "batch"),
        ):
            store.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {store.name(table)} ({columns}) USING parquet"
                f" PARTITIONED BY ({folders})")

    def _write(self, rows: DataFrame, table: str) -> None:
        """Replace the partitions that the rows have, by name."""
        columns = self.store.spark.table(self.store.name(table)).columns
        with writing_folders(rows.sparkSession):
            rows.select(*columns).write.insertInto(self.store.name(table), overwrite=True)

    def keep(self, cleaned: DataFrame, batch: int) -> None:
        """Put the rows of a batch by and log its files; one job reads, checks and writes the rows.

        A row without a date or ticker stops it, and nothing is put by.
        """
        wrong = F.col("trade_date").isNull() | F.col("ticker").isNull()
        tagged = quality.with_single_key(cleaned, wrong, "rows without a date or ticker in", [PATH]).withColumns({
            "batch": F.lit(batch).cast("long"), FOLDER: self.store.period_column(F.col("trade_date"))})
        try:
            with quality.key_errors():
                self._write(tagged.hint("rebalance", FOLDER), PENDING)
        except quality.DuplicateKeyError as error:
            raise quality.DataCheckError(str(error)) from None
        held = cleaned.sparkSession.table(self.store.name(PENDING)).where(F.col("batch") == batch)
        files = held.groupBy(PATH, "batch").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("trade_date").alias("first_day"),
            F.max("trade_date").alias("last_day"))
        self._write(files, FILES)

    def pending(self) -> dict[str, list[int]]:
        """Batches that hold rows of each folder not admitted; read from the list of partitions."""
        found: dict[str, list[int]] = {}
        for row in self.store.spark.sql(f"SHOW PARTITIONS {self.store.name(PENDING)}").collect():
            folder, batch = (part.partition("=")[2] for part in row.partition.split("/"))
            found.setdefault(folder, []).append(int(batch))
        return found

    def ripe(self, hold: int | None = None) -> list[str]:
        """Pending folders with at least ``hold`` later ones pending or stored."""
        hold = self.hold if hold is None else hold
        waiting = self.pending()
        if not hold or not waiting:
            return sorted(waiting)
        newest = sorted(set(self.store.periods()).union(waiting))[-hold:]
        return sorted(folder for folder in waiting if folder < newest[0])

    def admit(self, batch: int, hold: int | None = None) -> list[date]:
        """Take what is ripe into the panel, log its days, and drop its pending rows.

        Returns the days of the panel that were rewritten.
        """
        spark, folders = self.store.spark, self.ripe(hold)
        if not folders:
            return []
        waiting = self.pending()
        newest = spark.table(self.store.name(DAYS)).where(F.col("batch") < batch).agg(F.max("trade_date")).first()[0]
        rows = spark.table(self.store.name(PENDING)).where(F.col(FOLDER).isin(folders))
        days = late.refill_days(
            keep_last(rows, [PATH, "batch"]).select(*DAILY_MARKET_SNAPSHOT.columns), self.store)
        log = rows.select(*PANEL_KEY).distinct().groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"))
        is_late = F.lit(False) if newest is None else F.col("trade_date") < F.lit(newest)
        self._write(log.withColumns({"is_late": is_late, "batch": F.lit(batch).cast("long")}), DAYS)
        parts = ", ".join(
            f"PARTITION ({FOLDER} = '{folder}', batch = {n})" for folder in folders for n in waiting[folder])
        spark.sql(f"ALTER TABLE {self.store.name(PENDING)} DROP IF EXISTS {parts}")
        return days

    def finish(self) -> list[date]:
        """Admit all that is pending, ripe or not."""
        last = self.store.spark.table(self.store.name(FILES)).agg(F.max("batch")).first()[0]
        return self.admit(last + 1, hold=0) if last is not None else []

    def report(self, files: DataFrame) -> DataFrame:
        """path, outcome and n_rows of listed files: ``taken``, or ``failed`` if no row of it came."""
        log = self.store.spark.table(self.store.name(FILES))
        log = log.groupBy(F.col(PATH).alias("path")).agg(F.sum("n_rows").alias("n_rows"))
        listed = files.select(raw_files.plain_path(F.col("path")).alias("path"))
        return listed.join(log, "path", "left").select(
            "path", F.when(F.col("n_rows") > 0, "taken").otherwise("failed").alias("outcome"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def ingest_in_order(
    stream: DataFrame,
    store: Store,
    source: str,
    checkpoint: str,
    hold: int = 0,
    sequence: Sequence[str] = (raw_files.SEQUENCE,),
) -> StreamingQuery:
    """Take in all landed files of one source, in any order of their days.

    Days that are not ripe when the files end stay pending for the next run;
    ``OrderedLanding.finish`` admits them.
    """
    landing = OrderedLanding(store, hold)

    def handle(batch: DataFrame, number: int) -> None:
        rows = raw_files.number_rows(batch)
        landing.keep(
            daily.clean_snapshot(rows, layout_of(source), sequence, keep=(PATH,), suffix=True), number)
        landing.admit(number)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
