"""Contract checks and conversions.

Checks come in two forms: raising guards, and reports. A report is a DataFrame
(rule, file, trade_date, ticker, value), so one job checks a whole history.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..contracts import fixed_values as fixed
from ..contracts import get_table
from ..functions import dates, numbers, tickers
from . import keys as key_ops


class ValidationError(Exception):
    """Base of all contract errors."""


class _ColumnsError(ValidationError):
    label = ""

    def __init__(self, columns: Iterable[str], table: str | None = None):
        self.columns, self.table = set(columns), table
        where = f"[{table}] " if table else ""
        super().__init__(f"{where}{self.label} columns: {sorted(self.columns)}")


class MissingColumnsError(_ColumnsError):
    label = "Missing"

    @property
    def missing(self) -> set[str]:
        return self.columns


class ExtraColumnsError(_ColumnsError):
    label = "Extra"

    @property
    def extra(self) -> set[str]:
        return self.columns


class TypeConversionError(ValidationError):
    def __init__(self, column: str, dtype: str, errors: int, table: str | None = None):
        self.column, self.dtype, self.errors, self.table = column, dtype, errors, table
        where = f"[{table}] " if table else ""
        super().__init__(f"{where}{errors} values of {column!r} are not {dtype}")


class DuplicateKeyError(ValidationError):
    """Rows share a key, or a key is NULL."""


class DataCheckError(ValidationError):
    """A data rule failed; the message shows a few offenders."""


# --- key checks within a job: rows that break them stop it ---------------------

_BROKEN_KEY = "broken key"


def _stop(message: str, key: Sequence[str]) -> Column:
    shown = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in key])
    return F.raise_error(F.concat(F.lit(f"{_BROKEN_KEY}: {message} {tuple(key)}: "), shown))


def _or_stop(df: DataFrame, wrong: Column, message: str, key: Sequence[str]) -> DataFrame:
    """The check is part of a key column, so no plan can leave it out."""
    first = key[0]
    checked = F.when(wrong, _stop(message, key).cast(df.schema[first].dataType)).otherwise(F.col(first))
    return df.withColumn(first, checked)


def with_whole_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df``, which stops its job at a NULL in the key."""
    return _or_stop(df, _any_null(key), "NULL in", key)


def with_unique_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df``, which stops its job at a NULL or repeated key.

    NULL keys are met before the shuffle. Within a key rows are numbered, not gathered.
    """
    line = Window.partitionBy(*key).orderBy(F.lit(0))
    numbered = with_whole_key(df, key).withColumn("_copy", F.row_number().over(line))
    return _or_stop(numbered, F.col("_copy") > 1, "repeated", key).drop("_copy")


def with_single_key(df: DataFrame, wrong: Column, message: str, key: Sequence[str]) -> DataFrame:
    """``df``, which stops its job at a row whose key is ``wrong``."""
    return _or_stop(df, wrong, message, key)


def require_new_keys(df: DataFrame, key: Sequence[str], stored: DataFrame | None = None) -> None:
    """A key that ``df`` repeats or ``stored`` holds is an error. Only key columns are shuffled."""
    keys = df.select(*key, F.lit(1).alias("_sent"))
    if stored is not None:
        keys = keys.unionByName(stored.select(*key, F.lit(0).alias("_sent")))
    counted = keys.groupBy(*key).agg(F.sum("_sent").alias("n_sent"), F.count(F.lit(1)).alias("n_rows"))
    broken = first_rows(counted.where("n_sent > 0 and n_rows > 1"), 1)
    for row in broken:
        message = "repeated" if row.n_sent > 1 else "already stored"
        raise DuplicateKeyError(f"{message} {tuple(key)}: " + ", ".join(str(row[c]) for c in key))


@contextmanager
def key_errors():
    """Gives the error of a job that a key check stopped its own class."""
    try:
        yield
    except PySparkException as error:
        found = re.search(rf"{_BROKEN_KEY}: ([^\n]*)", str(error))
        if not found:
            raise
        raise DuplicateKeyError(found.group(1)) from None


# --- column checks: no job ---------------------------------------------------


def check_missing_columns(
    df: DataFrame, required: Iterable[str], table: str | None = None
) -> None:
    missing = set(required) - set(df.columns)
    if missing:
        raise MissingColumnsError(missing, table)


def check_extra_columns(
    df: DataFrame, expected: Iterable[str], table: str | None = None, strict: bool = False
) -> set[str]:
    extra = set(df.columns) - set(expected)
    if extra and strict:
        raise ExtraColumnsError(extra, table)
    return extra


def validate_schema(
    df: DataFrame, table: str, allow_extra: bool = True
) -> tuple[bool, set[str], set[str]]:
    """(ok, missing, extra) against a contract; raises as the flags ask."""
    wanted = get_table(table).columns
    check_missing_columns(df, wanted, table)
    return True, set(), check_extra_columns(df, wanted, table, strict=not allow_extra)


def column_report(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Each column of the frame or of the contract: rule, expected_place, place, n_values.

    rule is ok, missing, extra or misplaced; places count from 1. n_values tells whether an
    extra column holds anything: one aggregation counts all columns.
    """
    places = {c: i for i, c in enumerate(df.columns, 1)}
    wanted = {c: i for i, c in enumerate(expected, 1)}
    rows = []
    for c in [*wanted, *[c for c in df.columns if c not in wanted]]:
        rule = (
            "missing" if c not in places else "extra" if c not in wanted
            else "ok" if places[c] == wanted[c] else "misplaced"
        )
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(rule).alias("rule"),
            F.lit(wanted.get(c)).cast("int").alias("expected_place"), F.lit(places.get(c)).cast("int").alias("place"),
            (F.count(F.col(f"`{c}`")) if c in places else F.lit(0).cast("bigint")).alias("n_values"),
        ))
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def check_column_order(df: DataFrame, expected: Sequence[str]) -> None:
    if list(df.columns) != list(expected):
        raise ValidationError(f"expected columns {list(expected)}, got {df.columns}")


# --- conversions: one generated select --------------------------------------


def _chosen(df: DataFrame, columns: Sequence[str] | None, group: Sequence[str]) -> list[str]:
    return [c for c in (columns or group) if c in df.columns]


def convert_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, errors: str = "coerce"
) -> DataFrame:
    """Columns of text go through one expression over an array: the rule written out for each
    of a dozen columns makes a method that is too large for the JVM to compile."""
    chosen = _chosen(df, columns, fixed.NUMERIC_FIELDS)
    texts = [c for c in chosen if isinstance(df.schema[c].dataType, T.StringType)]
    if errors != "coerce" or len(texts) < 3:
        texts = []
    others = {
        c: numbers.to_number(F.col(c), df.schema[c].dataType, errors) for c in chosen if c not in texts}
    if not texts:
        return df.withColumns(others)
    read = F.transform(F.array(*texts), lambda x: numbers.to_number(x, T.StringType()))
    held = df.withColumn("_numbers", read)
    return held.withColumns(
        {**others, **{c: F.col("_numbers")[place] for place, c in enumerate(texts)}}).drop("_numbers")


def convert_boolean(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    true_words: Iterable[str] | None = None,
    false_words: Iterable[str] | None = None,
) -> DataFrame:
    return df.withColumns(
        {
            c: numbers.to_boolean(F.col(c), true_words, false_words)
            for c in _chosen(df, columns, fixed.BOOLEAN_FIELDS)
        }
    )


def _as_date(column: str, dtype: T.DataType, date_format: str | None) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column).cast("date")
    return dates.parse_date(F.col(column), date_format, with_time=True)


def convert_date(
    df: DataFrame, columns: Sequence[str] | None = None, date_format: str | None = None
) -> DataFrame:
    return df.withColumns(
        {
            c: _as_date(c, df.schema[c].dataType, date_format)
            for c in _chosen(df, columns, fixed.DATE_FIELDS)
        }
    )


def canonicalize(
    df: DataFrame,
    numeric_columns: Sequence[str] | None = None,
    boolean_columns: Sequence[str] | None = None,
    date_columns: Sequence[str] | None = None,
    date_format: str | None = None,
) -> DataFrame:
    df = convert_numeric(df, numeric_columns)
    df = convert_boolean(df, boolean_columns)
    return convert_date(df, date_columns, date_format)


def quick_validate(
    df: DataFrame, table: str, allow_extra: bool = True, auto_convert: bool = True
) -> DataFrame:
    validate_schema(df, table, allow_extra)
    return canonicalize(df) if auto_convert else df


# --- reports -----------------------------------------------------------------


def conversion_failures(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_failed): values present as text that do not convert.

    Blank text counts as absent. All columns are counted in one pass.
    """
    chosen = columns or [
        c
        for c in raw.columns
        if c in fixed.NUMERIC_FIELDS + fixed.BOOLEAN_FIELDS + fixed.DATE_FIELDS
    ]
    counts = raw.agg(
        *[
            F.count_if(
                (tickers.strip(F.col(c).cast("string")) != "")
                & _converted(c, raw.schema[c].dataType).isNull()
            ).alias(c)
            for c in chosen
        ]
    )
    return counts.unpivot([], list(chosen), "column_name", "n_failed")


def _converted(column: str, dtype: T.DataType) -> Column:
    if column in fixed.BOOLEAN_FIELDS:
        return numbers.to_boolean(F.col(column))
    if column in fixed.DATE_FIELDS:
        return _as_date(column, dtype, None)
    return numbers.to_number(F.col(column), dtype)


def check_conversions(
    raw: DataFrame,
    columns: Sequence[str] | None = None,
    allowed: int = 0,
    table: str | None = None,
) -> None:
    """Raise for the worst column with more than ``allowed`` failed values."""
    worst = (
        conversion_failures(raw, columns)
        .where(F.col("n_failed") > allowed)
        .orderBy(F.desc("n_failed"), "column_name")
        .first()
    )
    if worst:
        kind = (
            "BOOLEAN"
            if worst.column_name in fixed.BOOLEAN_FIELDS
            else "DATE" if worst.column_name in fixed.DATE_FIELDS else "DOUBLE"
        )
        raise TypeConversionError(worst.column_name, kind, worst.n_failed, table)


def split_valid_tickers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) by ticker format; together they are the input."""
    good = tickers.is_suffixed_ticker(F.col("ticker"))
    return df.where(good), df.where(~good)


def file_dates(
    df: DataFrame, file: str = "file_name", file_date: str = "file_date"
) -> DataFrame:
    """Per file: its date, how many dates it holds, the smallest, and whether it agrees.

    A file without a date in its name is not judged.
    """
    return (
        df.groupBy(file)
        .agg(
            F.min(file_date).alias("file_date"),
            F.count_distinct("trade_date").alias("n_dates"),
            F.min("trade_date").alias("min_date"),
            F.max("trade_date").alias("max_date"),
            F.count_if(F.col("trade_date").isNull()).alias("n_undated"),
        )
        .withColumn(
            "agrees",
            F.when(
                F.col("file_date").isNotNull(),
                (F.col("n_dates") == 1)
                & (F.col("n_undated") == 0)
                & (F.col("min_date") == F.col("file_date")),
            ),
        )
    )


def empty_files(files: DataFrame, rows: DataFrame, file: str = "file_name") -> DataFrame:
    """Listed files that delivered no row."""
    return files.join(rows.select(file).distinct(), file, "left_anti")


def quality_report(
    df: DataFrame, file: str = "file_name", file_date: str = "file_date",
    form: Callable[[Column], Column] = tickers.is_suffixed_ticker,
) -> DataFrame:
    """Every broken rule of a delivery: ticker format, missing or repeated key,
    and files whose content is not of one date, their own. ``form`` is the market's
    rule for tickers."""
    columns = ["rule", "file", "trade_date", "ticker", "value"]
    name = F.col(file) if file in df.columns else F.lit(None).cast("string")
    row_rules = F.array_compact(
        F.array(
            F.when(~form(F.col("ticker")), F.lit("ticker_format")),
            F.when(
                F.col("trade_date").isNull() | F.col("ticker").isNull(), F.lit("missing_key")
            ),
        )
    )
    found = df.select(
        F.explode(row_rules).alias("rule"),
        name.alias("file"),
        "trade_date",
        "ticker",
        F.col("ticker").alias("value"),
    )
    # a key may come again in a later file, which then wins; not within one file
    per_file = df.withColumn("_file", name)
    repeated = key_ops.duplicate_keys(per_file, ["_file", *key_ops.PANEL_KEY]).select(
        F.lit("repeated_key").alias("rule"),
        F.col("_file").alias("file"),
        "trade_date",
        "ticker",
        F.col("n_rows").cast("string").alias("value"),
    )
    found = found.unionByName(repeated)
    if file in df.columns and file_date in df.columns:
        wrong = file_dates(df, file, file_date).where(~F.col("agrees"))
        found = found.unionByName(
            wrong.select(
                F.lit("file_date").alias("rule"),
                F.col(file).alias("file"),
                F.col("min_date").alias("trade_date"),
                F.lit(None).cast("string").alias("ticker"),
                F.col("n_dates").cast("string").alias("value"),
            )
        )
    return found.select(*columns)


# --- raising guards: each one job, shown offenders bounded -------------------


def first_rows(df: DataFrame, n: int = 5) -> list[Row]:
    """Up to ``n`` rows, looked for by all tasks at once.

    A plain ``limit`` looks through one task's rows first and then through a few more at a
    time, so a check that finds nothing would run its tasks in rounds.
    """
    found = df.limit(n).agg(F.collect_list(F.struct(*df.columns)).alias("rows")).first()
    return list(found.rows)


def require_unique_key(df: DataFrame, keys: Sequence[str] = key_ops.PANEL_KEY) -> None:
    broken = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where((F.col("n_rows") > 1) | _any_null(keys))
    )
    broken = first_rows(broken)
    if broken:
        raise DuplicateKeyError(f"key {tuple(keys)} repeated or NULL: {broken}")


def _any_null(keys: Sequence[str]) -> Column:
    test = F.col(keys[0]).isNull()
    for key in keys[1:]:
        test = test | F.col(key).isNull()
    return test


def require_clean(report: DataFrame) -> None:
    """Raise when a report holds any row."""
    shown = first_rows(report)
    if shown:
        raise DataCheckError(f"data rules broken, for example: {shown}")


def require_rows(df: DataFrame, what: str = "input") -> None:
    if df.isEmpty():
        raise DataCheckError(f"{what} is empty")
