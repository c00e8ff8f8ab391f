"""The persistent store: Parquet catalog tables, the panel partitioned by date.

Parquet has no row updates. Every change is one job that rewrites only the
partitions it touches, by dynamic partition overwrite; Spark stages the new files
and puts them in place when the job commits, so a lost executor or a failed check
leaves the old partition whole. The panel is partitioned by ``trade_date``, or by
a coarser ``period`` where a day is far smaller than a file should be. Small unpartitioned tables are written to a fresh folder and
the catalog entry is pointed at it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import ALL_TABLES, TableContract, get_table
from ..contracts import fixed_values as fixed
from ..functions.dates import spark_pattern
from ..operators import calendar as cal
from ..operators import quality
from ..operators.keys import with_keys_in, with_keys_not_in
from ..operators.shaping import conform, to_type
from ..session import kept_rows, writing_folders

PANEL = "daily_market_snapshot"
PHASE = "market_phase"
TRADES = "trade_execution"
NOTES = "notes"
#: Beside the panel's contract: whether a row was carried forward from an earlier day.
MARK = "is_carried"

Day = date | str

PERIOD = "period"
_PERIOD_FORMATS = {"day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}


class Store:
    """``grain`` sizes the panel's partitions: day, month or year.

    Day suits days of a gigabyte and more. Take month or year when days are
    small: thousands of folders of a few kilobytes cost far more to list and
    open than to rewrite with their neighbours.
    """

    def __init__(self, spark: SparkSession, database: str, root: str, grain: str = "day"):
        if grain not in _PERIOD_FORMATS:
            raise ValueError(f"grain must be one of {list(_PERIOD_FORMATS)}, not {grain!r}")
        self.spark, self.database, self.root = spark, database, root.rstrip("/")
        self.grain = grain
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.root}'")

    def _period_of(self, day: Day) -> str:
        moment = day if isinstance(day, date) else date.fromisoformat(day)
        return moment.strftime(_PERIOD_FORMATS[self.grain])

    # --- catalog -------------------------------------------------------------

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create_tables(self, contracts: Sequence[TableContract] = ALL_TABLES) -> None:
        period = None if self.grain == "day" else PERIOD
        for contract in contracts:
            location = f"{self.root}/{contract.name}/v0"
            mark = MARK if contract.name == PANEL else None
            self.spark.sql(contract.create_sql(self.name(contract.name), location, period, mark))

    def list_tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def describe(self, table: str) -> DataFrame:
        return self.spark.sql(f"DESCRIBE TABLE {self.name(table)}")

    def table(
        self,
        table: str,
        start_date: Day | None = None,
        end_date: Day | None = None,
        marked: bool = False,
    ) -> DataFrame:
        """A stored table, contract columns first and in order.

        Given dates prune partitions and rows. ``marked`` keeps the mark of carried rows.
        """
        df = self.spark.table(self.name(table))
        if PERIOD in df.columns:
            if start_date:
                df = df.where(F.col(PERIOD) >= self._period_of(start_date))
            if end_date:
                df = df.where(F.col(PERIOD) <= self._period_of(end_date))
        df = between_days(df, start_date=start_date, end_date=end_date)
        wanted = [c for c in get_table(table).columns if c in df.columns]
        hidden = (*wanted, PERIOD) if marked else (*wanted, PERIOD, MARK)
        return df.select(*wanted, *[c for c in df.columns if c not in hidden])

    def days(self, table: str = PANEL) -> DataFrame:
        """Stored days. With day partitions they come from the catalog's partition
        list and no data is read."""
        if self.grain != "day":
            return cal.trading_days(self.table(table))
        parts = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}")
        return parts.select(
            F.regexp_extract("partition", "trade_date=([^/]+)", 1)
            .try_cast("date")
            .alias("trade_date")
        ).where("trade_date is not null")

    def period_column(self, day: Column) -> Column:
        """The partition of the panel that a day belongs to, as text."""
        return F.date_format(day, spark_pattern(_PERIOD_FORMATS[self.grain]))

    def periods(self) -> list[str]:
        """The panel's stored partitions in date order, from the catalog."""
        parts = self.spark.sql(f"SHOW PARTITIONS {self.name(PANEL)}").collect()
        return sorted(row.partition.partition("=")[2] for row in parts)

    # --- queries -------------------------------------------------------------

    def snapshot(
        self,
        trade_date: Day | None = None,
        ticker: str | None = None,
        start_date: Day | None = None,
        end_date: Day | None = None,
    ) -> DataFrame:
        panel = self.table(PANEL, trade_date or start_date, trade_date or end_date, marked=True)
        return query_panel(panel, trade_date, ticker, start_date, end_date)

    def phases(
        self,
        trade_date: Day | None = None,
        start_date: Day | None = None,
        end_date: Day | None = None,
    ) -> DataFrame:
        found = between_days(self.table(PHASE), trade_date, start_date, end_date)
        return found.orderBy("trade_date")

    def trades(self, trade_id: str | None = None) -> DataFrame:
        return query_trades(self.table(TRADES), trade_id)

    def previous_trade_date(self, day: Day) -> date | None:
        """The last stored day before ``day``. With periods, the newest that may hold
        it are looked at one by one, so that no other is read."""
        if self.grain == "day":
            return cal.previous_trade_date(self.days(), day).first()[0]
        before = F.col("trade_date") < F.lit(day).cast("date")
        for period in reversed([p for p in self.periods() if p <= self._period_of(day)]):
            found = self.spark.table(self.name(PANEL)).where((F.col(PERIOD) == period) & before)
            if (latest := found.agg(F.max("trade_date")).first()[0]) is not None:
                return latest
        return None

    def day_before(self, day: Day) -> DataFrame:
        """The slice of the last stored day before ``day``; empty when none is stored."""
        before = self.previous_trade_date(day)
        if before is None:
            return self.table(PANEL).where(F.lit(False))
        return self.table(PANEL, before, before)

    # --- writing -------------------------------------------------------------

    def _ready(self, df: DataFrame, table: str) -> DataFrame:
        """Conform a batch to its contract; a NULL created_at becomes load time."""
        contract = get_table(table)
        if table == PANEL:
            mark = F.coalesce(MARK, F.lit(False)) if MARK in df.columns else F.lit(False)
            df = conform(df.withColumn(MARK, mark), contract, typed=True, keep=[MARK])
        else:
            df = conform(df, contract, typed=True)
        if "created_at" in contract.columns:
            df = df.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        return df

    @contextmanager
    def scratch(self) -> Iterator[str]:
        """A folder below the store's own that is gone afterwards."""
        folder = f"{self.root}/_staging/{uuid.uuid4().hex[:12]}"
        try:
            yield folder
        finally:
            files, path = self._files(folder)
            files.delete(path, True)

    def exists(self, folder: str) -> bool:
        files, path = self._files(folder)
        return files.exists(path)

    def report_folder(self) -> str:
        return f"{self.root}/_reports/{uuid.uuid4().hex[:12]}"

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    @contextmanager
    def kept(self, rows: DataFrame) -> Iterator[DataFrame]:
        """Rows that are taken several times, written once below the store's folder."""
        with quality.key_errors():
            with kept_rows(rows, f"{self.root}/_staging/{uuid.uuid4().hex[:12]}") as found:
                yield found

    @contextmanager
    def _staged(
        self, batch: DataFrame, contract: TableContract, stored: str | None = None,
        check: bool = True,
    ) -> Iterator[tuple[DataFrame, list[date]]]:
        """A batch checked and written once, and the days it touches.

        Reading the source and finding the days are one job: a NULL key stops it, and the
        days come back as an observed metric. The rows are written as they come; only the
        staged keys are then shuffled to find a repeated one, or with ``stored`` one that this
        table holds; without ``check`` the write that follows does so (``_dealt``). What
        follows reads the staged rows, which are gone afterwards.
        """
        metric = Observation()
        rows = quality.with_whole_key(batch, contract.key)
        if contract.partition_by:
            rows = rows.observe(metric, *_day_metrics(F.col("trade_date")))
        with self.kept(rows) as found:
            days = []
            if contract.partition_by:
                days = _days_of(metric.get)
                if days is None:
                    days = [row.trade_date for row in cal.trading_days(found).collect()]
            if check:
                held = None if stored is None else self._slice(stored, days)
                quality.require_new_keys(found, contract.key, held)
            yield found, days

    def staged_batch(self, batch: DataFrame):
        """Rows of the panel written once, and their days. A NULL key is an error; a repeated
        one is left to what follows."""
        return self._staged(batch, get_table(PANEL), check=False)

    def _slice(self, table: str, days: Sequence[date]) -> DataFrame:
        """The stored rows of the partitions that a batch on ``days`` touches."""
        stored = self.spark.table(self.name(table))
        if days and PERIOD in stored.columns:
            periods = sorted({self._period_of(day) for day in days})
            return stored.where(F.col(PERIOD).isin(periods)).drop(PERIOD)
        return stored.where(F.col("trade_date").isin(list(days))) if days else stored

    def _dealt(
        self, stored: DataFrame, batch: DataFrame, message: str = "", was: Sequence[str] = (),
        sent: Mapping[date, int] | None = None,
    ) -> DataFrame:
        """Stored and sent rows of the panel by partition and key, marked ``_sent``, in one shuffle.

        The write needs its rows by partition anyway, so the rows of a key meet there too: a
        partition goes to one task, one of many rows in shares of its tickers. ``_updates`` tells
        a sent row whose key is stored and ``_last`` the row that stays; both follow from the
        sorted rows next to each other. A key sent twice stops the job, with ``message`` a stored
        one too. ``_was`` holds the columns ``was`` of the row before. ``sent`` has the batch's
        rows by day where they are known and costly to make twice.
        """
        key = get_table(PANEL).key
        folder = "trade_date" if self.grain == "day" else PERIOD
        period = F.col("trade_date") if self.grain == "day" else self.period_column(F.col("trade_date"))
        days = stored.select("trade_date")
        days = days if sent is not None else days.union(batch.select("trade_date"))
        counts = Counter()
        for day, n in (sent or {}).items():
            counts[self._period_of(day)] += n
        for row in days.groupBy(period.cast("string").alias("p")).count().collect():
            counts[row.p] += row["count"]
        most = max(counts.values(), default=0)
        rows = stored.withColumn("_sent", F.lit(False)).unionByName(
            batch.withColumn("_sent", F.lit(True)), allowMissingColumns=True)
        shares = F.lit(-(-most // _SHARE_ROWS) or 1)
        # enough tasks that each sorts its rows in memory: a spill would be one more copy on disk
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * sum(counts.values()) // _SHARE_ROWS))
        rows = rows.withColumns({
            folder: period, "_share": F.pmod(F.xxhash64(*key), shares)}).repartition(tasks, folder, "_share")
        return with_neighbours(rows, key, [folder, "_share"], message, was)

    def _put(self, df: DataFrame, table: str, mode: str, dealt: bool = False) -> None:
        """Write by name: ``append``, ``days`` (replace touched days) or ``all``.

        Rows that are ``dealt`` by partition already are written as they lie.
        """
        target = self.spark.table(self.name(table))
        contract = get_table(table)
        columns = []
        for field in target.schema.fields:
            if field.name == PERIOD:
                value = F.col(PERIOD) if dealt else self.period_column(F.col("trade_date"))
            elif field.name in df.columns:
                value = to_type(F.col(field.name), df.schema[field.name].dataType, field.dataType)
            else:
                value = F.lit(None).cast(field.dataType)
            columns.append(value.alias(field.name))
        df = df.select(*columns)
        if not contract.partition_by:
            if mode == "append":
                df.write.insertInto(self.name(table))
            else:
                self._swap(df, table)
            return
        # some partitions may be far larger than others: rebalance splits them into
        # files of advisory size instead of one task per partition
        if not dealt:
            folders = [PERIOD] if PERIOD in df.columns else list(contract.partition_by)
            sort = [*folders, *[k for k in reversed(contract.key) if k not in folders]]
            df = df.hint("rebalance", *folders).sortWithinPartitions(*sort)
        # the frame's own session counts: a stream's batches run in a clone of it
        with writing_folders(df.sparkSession, "static" if mode == "all" else "dynamic"):
            df.write.insertInto(self.name(table), overwrite=mode != "append")

    def _swap(self, df: DataFrame, table: str) -> None:
        fresh = f"{self.root}/{table}/v-{uuid.uuid4().hex[:12]}"
        df.write.parquet(fresh)
        self.spark.sql(f"ALTER TABLE {self.name(table)} SET LOCATION '{fresh}'")
        self.spark.catalog.refreshTable(self.name(table))

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows; a key already stored, repeated or NULL is an error.

        Stored keys are looked up before the staged rows are put in place; in the panel the
        job that puts them meets those keys, and what it wrote is in place only if it ends.
        """
        contract = get_table(table)
        if contract.partition_by:
            with self._staged(self._ready(df, table), contract, check=False) as (batch, days):
                if days:
                    held = self._slice(table, days).select(*contract.key)
                    rows = self._dealt(held, batch, "already stored").where("_sent")
                    with quality.key_errors():
                        self._put(rows, table, "append", dealt=True)
            return
        with self._staged(self._ready(df, table), get_table(table), table) as (batch, _):
            self._put(batch, table, "append")

    def replace_by_key(self, table: str, df: DataFrame) -> None:
        """Delete the rows whose key is in the batch, then insert the batch."""
        contract = get_table(table)
        if contract.partition_by:
            with self._staged(self._ready(df, table), contract, check=False) as (batch, days):
                if days:
                    rows = self._dealt(self._slice(table, days), batch).where("_last")
                    with quality.key_errors():
                        self._put(rows, table, "days", dealt=True)
            return
        with self._staged(self._ready(df, table), contract) as (batch, days):
            stored = self._slice(table, days)
            kept = with_keys_not_in(stored, batch, contract.key)
            self._put(kept.unionByName(batch, allowMissingColumns=True), table, "days")

    def save(self, table: str, df: DataFrame, replace: bool = False) -> None:
        """Validate and coerce, then append or replace by key."""
        df = quality.quick_validate(df, table)
        self.replace_by_key(table, df) if replace else self.append(table, df)

    def upsert(self, df: DataFrame, columns: Sequence[str] = fixed.LOADER_COLUMNS) -> None:
        """Insert new keys, update the value ``columns`` of known ones.

        The batch wins with its NULLs too. ``created_at`` and columns outside
        ``columns`` keep their stored values.
        """
        with self._staged(self._ready(df, PANEL), get_table(PANEL), check=False) as (batch, days):
            if days:
                stored = self._slice(PANEL, days)
                kept = [c for c in stored.columns if c not in (*get_table(PANEL).key, *columns, MARK)]
                with quality.key_errors():
                    merged = merge_rows(self._dealt(stored, batch, was=kept), kept)
                    self._put(merged, PANEL, "days", dealt=True)

    def replace_day(self, df: DataFrame, trade_date: Day) -> int:
        """Make ``df`` the whole content of one day; returns the rows stored for it."""
        day = date.fromisoformat(trade_date) if isinstance(trade_date, str) else trade_date
        batch = self._ready(df, PANEL).where(F.col("trade_date") == day)
        if batch.isEmpty():
            self._delete_day(day)
            return 0
        self.replace_days(batch)
        return self.table(PANEL, day, day).count()

    def replace_days(self, df: DataFrame) -> None:
        """``replace_day`` for every day of the batch in one job.

        By days nothing stored is needed, so the rows go straight to their partitions.
        Otherwise key checks and write share one shuffle (``_dealt``).
        """
        contract, batch = get_table(PANEL), self._ready(df, PANEL)
        if self.grain == "day":
            with quality.key_errors():
                self._put(quality.with_unique_key(batch, contract.key), PANEL, "days")
            return
        with self._staged(batch, contract, check=False) as (rows, days):
            if days:
                neighbours = self._slice(PANEL, days).where(~F.col("trade_date").isin(days))
                with quality.key_errors():
                    self._put(self._dealt(neighbours, rows).where("_last"), PANEL, "days", dealt=True)

    def patch(
        self, rows: DataFrame, keys: DataFrame | None, days: Sequence[date],
        may_empty: bool = False, sent: Mapping[date, int] | None = None, below: DataFrame | None = None,
    ) -> None:
        """Drop the panel's rows whose key is in ``keys``, add ``rows``, marks included.

        Without ``keys`` the rows take the place of those with their keys, ``sent`` of each day;
        ``below`` are rows with keys not stored, of which those stay that ``rows`` lack. Only the
        partitions of ``days`` are rewritten. With ``may_empty`` a day that is left without a row goes.
        """
        if keys is None:
            stored = self._slice(PANEL, days)
            if below is not None:
                stored = stored.unionByName(self._ready(below, PANEL), allowMissingColumns=True)
            content = self._dealt(stored, self._ready(rows, PANEL), sent=sent)
            with quality.key_errors():
                self._put(content.where("_last"), PANEL, "days", dealt=True)
            return
        kept = with_keys_not_in(self._slice(PANEL, days), keys, get_table(PANEL).key)
        content = kept.unionByName(self._ready(rows, PANEL), allowMissingColumns=True)
        empty = set(days) if may_empty else set()
        if empty:
            empty -= {row.trade_date for row in cal.trading_days(content).collect()}
        self._put(content, PANEL, "days")
        for day in empty:
            self._delete_day(day)

    def _delete_day(self, day: date) -> None:
        if self.grain != "day":
            rest = self._slice(PANEL, [day]).where(F.col("trade_date") != day)
            if not rest.isEmpty():
                self._put(rest, PANEL, "days")
                return
        self._drop_period(self._period_of(day))

    def _drop_period(self, period: str) -> None:
        column = "trade_date" if self.grain == "day" else PERIOD
        self.spark.sql(
            f"ALTER TABLE {self.name(PANEL)} DROP IF EXISTS PARTITION ({column} = '{period}')"
        )

    def rebuild(self, canonical_path: str) -> list[str]:
        """Make the canonical files the panel's whole content; returns the partitions changed.

        Both sides give a digest of each partition that no order of rows changes, without
        the time of loading. Only partitions whose digests differ are written, and those
        that the files lack are dropped. One row per partition reaches the driver.
        """
        raw = self.spark.read.parquet(canonical_path)
        contract = get_table(PANEL)
        whole = self._ready(quality.canonicalize(conform(raw, contract)), PANEL)
        with quality.key_errors():
            wanted = self._digests(whole, contract.key)
            held = self._digests(self.spark.table(self.name(PANEL)))
            differ = (
                wanted.alias("w").join(held.alias("h"), PERIOD, "full_outer")
                .where(~F.col("w.digest").eqNullSafe(F.col("h.digest")))
                .select(PERIOD, F.col("w.digest").isNull().alias("gone"))
                .collect()
            )
        changed = sorted(row[PERIOD] for row in differ if not row.gone)
        if changed:
            of_changed = self.period_column(F.col("trade_date")).isin(changed)
            self._put(whole.where(of_changed), PANEL, "days")
        gone = sorted(row[PERIOD] for row in differ if row.gone)
        for period in gone:
            self._drop_period(period)
        return sorted([*changed, *gone])

    def _digests(self, rows: DataFrame, unique: Sequence[str] = ()) -> DataFrame:
        """(period, digest): rows, and sums of two hashes of all columns but created_at.

        A key ``unique`` is checked beside the hashes, so no other column is shuffled for it.
        """
        columns = [c for c in rows.columns if c not in ("created_at", PERIOD)]
        ordered = sorted(columns)
        rows = rows.withColumn(MARK, F.coalesce(MARK, F.lit(False))) if MARK in columns else rows
        hashed = rows.select(
            *(unique or ["trade_date"]), F.xxhash64(*ordered).alias("_first"),
            F.xxhash64(F.lit(1), *ordered).alias("_second"))
        hashed = quality.with_unique_key(hashed, unique) if unique else hashed
        return hashed.groupBy(self.period_column(F.col("trade_date")).alias(PERIOD)).agg(
            F.struct(
                F.count(F.lit(1)), F.sum(F.col("_first").cast("decimal(20,0)")), F.bit_xor("_second")
            ).alias("digest"))

    def add_note(self, df: DataFrame) -> None:
        """Append review notes after a check of their scope and ids."""
        notes = conform(df, get_table(NOTES), typed=True)
        known = F.coalesce(F.col("scope").isin(*fixed.NOTE_SCOPES), F.lit(False))
        wrong = notes.where(~known).limit(5).collect()
        if wrong:
            raise quality.DataCheckError(f"note scope must be one of {fixed.NOTE_SCOPES}: {wrong}")
        key = get_table(NOTES).key
        quality.require_unique_key(notes, key)
        known = with_keys_in(self.table(NOTES), notes, key).limit(5).collect()
        if known:
            raise quality.DuplicateKeyError(f"notes already hold ids {[row.id for row in known]}")
        notes = notes.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        self._put(notes, NOTES, "append")

    # --- maintenance -----------------------------------------------------------

    def ensure_column(self, column: str = "pre_close", table: str = PANEL) -> bool:
        """Add a contract column the stored table lacks; True when it was added."""
        if column in self.spark.table(self.name(table)).columns:
            return False
        dtype = get_table(table).schema[column].dataType.simpleString()
        self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS (`{column}` {dtype})")
        return True

    def repair_trade_date(self, broken: str, repaired: str = PANEL) -> DataFrame:
        """Rewrite a table whose trade_date has a time part into a dated table.

        Returns row counts and newest dates before and after.
        """
        before = self.spark.table(self.name(broken))
        fixed_rows = day_only_rows(before)
        quality.require_unique_key(fixed_rows)
        self._put(self._ready(fixed_rows, repaired), repaired, "all")
        return repair_report(before, self.table(repaired))


#: Rows of a partition that one task takes when rows are dealt by partition.
_SHARE_ROWS = 1_000_000

# --- the days of a batch as a metric ---------------------------------------------

_EPOCH = date(1970, 1, 1)
_BITMAP_DAYS = 1 << 15  # what one bitmap holds: to 2059


def _day_metrics(day: Column) -> list[Column]:
    """A bitmap of days, four kilobytes however many rows, and how many days it can not hold."""
    number = F.date_diff(day, F.lit(_EPOCH))
    return [
        F.bitmap_construct_agg(F.bitmap_bit_position((number + 1).cast("long"))).alias("days"),
        F.count_if((number < 0) | (number >= _BITMAP_DAYS)).alias("outside"),
    ]


def _days_of(metrics: Mapping) -> list[date] | None:
    """The days in a bitmap; None where it does not hold all of them."""
    if metrics["outside"]:
        return None
    return [
        _EPOCH + timedelta(days=8 * place + bit)
        for place, byte in enumerate(metrics["days"] or b"") for bit in range(8) if byte >> bit & 1
    ]


# --- the same steps on plain DataFrames ----------------------------------------


def between_days(
    df: DataFrame,
    trade_date: Day | None = None,
    start_date: Day | None = None,
    end_date: Day | None = None,
) -> DataFrame:
    """AND of the given date conditions; on the store they prune partitions."""
    day = F.col("trade_date")
    if trade_date:
        df = df.where(day == F.lit(trade_date).cast("date"))
    if start_date:
        df = df.where(day >= F.lit(start_date).cast("date"))
    if end_date:
        df = df.where(day <= F.lit(end_date).cast("date"))
    return df


def query_panel(
    panel: DataFrame,
    trade_date: Day | None = None,
    ticker: str | None = None,
    start_date: Day | None = None,
    end_date: Day | None = None,
) -> DataFrame:
    found = between_days(panel, trade_date, start_date, end_date)
    if ticker:
        found = found.where(F.col("ticker") == ticker)
    return found.orderBy("trade_date", "ticker")


def query_trades(trades: DataFrame, trade_id: str | None = None) -> DataFrame:
    if trade_id:
        return trades.where(F.col("trade_id") == trade_id)
    return trades.orderBy(F.col("entry_date").asc_nulls_last())


def with_neighbours(
    rows: DataFrame, key: Sequence[str], within: Sequence[str], message: str = "",
    was: Sequence[str] = (),
) -> DataFrame:
    """``_last``, ``_updates`` and ``_was`` of stored and sent rows, which lie ``within`` columns.

    Of a key there is a stored row, one that is sent, or both in this order. A second sent one
    stops the job, and with ``message`` a sent one after a stored one does too.
    """
    # by ticker and then day: a row and its copies on later days lie together, in fewer bytes
    line = Window.partitionBy(*within, *reversed(key)).orderBy("_sent")
    near = rows.withColumns({
        "_before": F.lag("_sent").over(line), "_last": F.lead("_sent").over(line).isNull(),
        "_was": F.lag(F.struct(*was)).over(line) if was else F.lit(None)})
    near = quality.with_single_key(near, F.coalesce("_before", F.lit(False)), "repeated", key)
    near = near.withColumn("_updates", F.col("_sent") & F.col("_before").isNotNull())
    return quality.with_single_key(near, F.col("_updates"), message, key) if message else near


def merge_rows(dealt: DataFrame, kept: Sequence[str]) -> DataFrame:
    """One row per key: a sent row that updates takes the stored values of the columns ``kept``.

    The batch's side is told by a marker, not by values.
    """
    return dealt.where("_last").withColumns({
        c: F.when(F.col("_updates"), F.col("_was")[c]).otherwise(F.col(c)) for c in kept})


def day_only_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("trade_date", F.col("trade_date").cast("date"))


def repair_report(before: DataFrame, after: DataFrame, n: int = 5) -> DataFrame:
    """(stage, n_rows, newest_dates) before and after a date repair."""

    def stage(df: DataFrame, label: str) -> DataFrame:
        newest = (
            df.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
            .agg(F.sort_array(F.collect_list(F.col("trade_date").cast("string")), False))
            .scalar()
        )
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(label).alias("stage"), "n_rows", newest.alias("newest_dates")
        )

    return stage(before, "before").unionByName(stage(after, "after"))
