"""Raw CSV layer: choosing, reading and writing delivered files.

Everything is read as text; types are the business of ``operators.quality``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import fixed_values as fixed
from ..functions import dates
from ..operators.shaping import add_absent
from ..session import listing_folders, settings, writing_folders

SNAPSHOT_GLOB = "*_Astock*.csv"
HISTORY_GLOB = "*.csv"

# helper columns added on read
FILE_COLUMNS = ("file_name", "file_path", "file_date", "file_source")
SEQUENCE = "_sequence"

#: Files that are listed and read at once: what the driver holds of each is about a kilobyte.
FILES_AT_ONCE = 20_000
# many files to a task: by Spark's own choice a task takes 32 however small they are
SMALL_FILES = {"spark__sql__files__openCostInBytes": "256k"}

# writes of very many small files: local ones get no checksum file beside each, which costs as
# much to make as the file; other file systems ignore this
PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def list_files(spark: SparkSession, root: str, glob: str = SNAPSHOT_GLOB) -> DataFrame:
    """(path, file_name, file_date, length) of matching files, contents unread."""
    with listing_folders(spark):
        listed = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true")
            .load(root)
        )
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("file_name"), "length").withColumn(
        "file_date", file_date(F.col("file_name"))
    )


def file_date(file_name: Column) -> Column:
    """Trade date in a snapshot file name, with or without a source part."""
    return F.regexp_extract(file_name, fixed.SNAPSHOT_FILE_PATTERN, 1).try_cast("date")


def file_source(file_name: Column) -> Column:
    source = F.regexp_extract(file_name, fixed.SNAPSHOT_FILE_PATTERN, 2)
    return F.when(source != "", source)


def plain_path(path: Column) -> Column:
    """A path in one form, however many slashes follow a local scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def snapshot_files(
    spark: SparkSession,
    root: str,
    date: str | None = None,
    year: int | str | None = None,
) -> list[str]:
    """Paths of one date, of one year, or else of the newest file.

    Only paths come back, and Spark's own file index holds those anyway.
    """
    files = list_files(spark, root)
    if date is not None:
        files = files.where(F.col("file_date") == F.lit(date).cast("date"))
    elif year is not None:
        files = files.where(F.year("file_date") == int(year))
    else:
        files = files.where(F.col("file_date").isNotNull()).orderBy(F.desc("path")).limit(1)
    paths = [row.path for row in files.select("path").orderBy("path").collect()]
    if not paths:
        raise FileNotFoundError(f"no snapshot file below {root} for {date or year or 'newest'}")
    return paths


def history_files(spark: SparkSession, root: str, limit: int | None = None) -> list[str]:
    """Per-stock files in name order, optionally the first ``limit``."""
    files = list_files(spark, root, HISTORY_GLOB).select("path").orderBy("path")
    if limit is not None:
        files = files.limit(limit)
    with settings(spark, **SMALL_FILES):
        paths = files.toArrow().column(0).to_pylist()  # texts alone, no row objects
    if not paths:
        raise FileNotFoundError(f"no history file below {root}")
    return paths


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Files of one header layout, all columns text, with file and sequence columns.

    Files whose header differs from the layout fail the read instead of being
    read by position; for mixed layouts see ``read_mixed_csv``.
    """
    reader = spark.read.option("header", "true").option("enforceSchema", "false")
    if columns is not None:
        reader = reader.schema(text_schema(columns))
    with listing_folders(spark):
        read = reader.csv(paths if isinstance(paths, str) else list(paths))
    return with_file_columns(read)


def with_file_columns(df: DataFrame) -> DataFrame:
    """Add file name, its date and source, and the row's place in the input.

    The sequence orders files by path and rows by their place in the file,
    however Spark packs files into tasks. A stream cannot number rows; there
    ``number_rows`` completes the sequence of each batch.
    """
    name = F.col("_metadata.file_name")
    tagged = df.withColumns(
        {
            "file_name": name,
            "file_path": plain_path(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))),
            "file_date": file_date(name),
            "file_source": file_source(name),
            SEQUENCE: F.struct(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("start"),
            ),
        }
    )
    return tagged if df.isStreaming else number_rows(tagged)


def number_rows(df: DataFrame) -> DataFrame:
    return df.withColumn(
        SEQUENCE,
        F.struct(f"{SEQUENCE}.*", F.monotonically_increasing_id().alias("place")),
    )


def chunks(values: Sequence, n: int) -> Iterator[list]:
    for start in range(0, len(values), n):
        yield list(values[start : start + n])


def header_layouts(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Paths by header line, from one pass over the text; files without a line have none.

    ``FILES_AT_ONCE`` files are listed at a time, so the driver holds no more than their
    statuses, and the paths.
    """
    layouts: dict[str, list[str]] = {}
    for some in chunks(paths, FILES_AT_ONCE):
        with listing_folders(spark), settings(spark, **SMALL_FILES):
            lines = spark.read.text(some).select(
                "value",
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("place"),
            )
            headers = (
                lines.where("start = 0").groupBy("path").agg(F.min_by("value", "place").alias("header"))
            )
            found = headers.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
            for row in sorted(found.collect(), key=lambda row: row.paths[0]):
                layouts.setdefault(row.header.lstrip("﻿"), []).extend(row.paths)
    return layouts


def mixed_csv(spark: SparkSession, paths: Sequence[str]) -> Iterator[DataFrame]:
    """Files of several header layouts, up to ``FILES_AT_ONCE`` of one layout in each frame.

    Every frame has the columns of all layouts, those its files lack as NULL.
    """
    layouts = list(header_layouts(spark, paths).values())
    columns = {c: "string" for group in layouts for c in read_csv(spark, group[:1]).columns if c != SEQUENCE}
    for group in layouts:
        for some in chunks(group, FILES_AT_ONCE):
            yield add_absent(read_csv(spark, some), columns)


def read_mixed_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of several header layouts, united by header name."""
    return reduce(DataFrame.unionByName, mixed_csv(spark, paths))


def fill_trade_date(df: DataFrame) -> DataFrame:
    """Take the trade date from the file name where the content has none."""
    from_name = F.date_format("file_date", "yyyy-MM-dd")
    if "trade_date" not in df.columns:
        return df.withColumn("trade_date", from_name)
    return df.withColumn("trade_date", F.coalesce(F.col("trade_date").cast("string"), from_name))


# folders of a raw landing; leave out the day when days are small
RAW_FOLDERS = ("year", "day", "source")


def write_raw(
    df: DataFrame, path: str, mode: str = "overwrite", folders: Sequence[str] = RAW_FOLDERS
) -> None:
    """Land text rows as CSV below year, day and source folders.

    The content keeps its own ``trade_date`` text. Only the delivered folders are
    replaced; ``mode='error'`` refuses an existing landing instead. The rebalance
    lets one busy day or source fill many files.
    """
    day = dates.parse_date(F.col("trade_date"), with_time=True)
    parts = {"year": F.year(day), "day": day}
    foldered = df.withColumns({name: parts[name] for name in folders if name in parts})
    with writing_folders(df.sparkSession):
        (
            foldered.hint("rebalance", *folders)
            .write.mode(mode)
            .partitionBy(*folders)
            .option("header", "true")
            .csv(path)
        )


def landed_days(spark: SparkSession, path: str) -> DataFrame:
    """(trade_date, source) of a landing by day and source, from its folders' names alone."""
    folders = list_files(spark, path, HISTORY_GLOB)
    day = F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1).try_cast("date")
    source = F.regexp_extract("path", r"/source=([^/]+)/", 1)
    found = folders.select(day.alias("trade_date"), source.alias("source"))
    return found.where("trade_date is not null and source <> ''").distinct()


def read_raw(
    spark: SparkSession,
    path: str,
    source: str,
    folders: Sequence[str] = RAW_FOLDERS,
    days: Sequence[date] | None = None,
) -> DataFrame:
    """One source's part of a ``write_raw`` landing; layouts differ between sources.

    Given ``days`` prune folders: files of other days are not opened, but for the one that
    tells the header.
    """
    reader = (
        spark.read.option("header", "true")
        .option("enforceSchema", "false")
        .option("basePath", path)
    )
    below = "/".join(f"source={source}" if name == "source" else f"{name}=*" for name in folders)
    if days is not None:
        first = min(days)
        parts = {"year": str(first.year), "day": first.isoformat(), "source": source}
        sample = "/".join(f"{name}={parts[name]}" for name in folders)
        header = spark.read.option("header", "true").csv(f"{path}/{sample}").columns
        reader = reader.schema(T.StructType([
            *text_schema(header).fields, T.StructField("year", T.IntegerType()),
            T.StructField("day", T.DateType()), T.StructField("source", T.StringType())]))
    with listing_folders(spark):
        read = reader.csv(f"{path}/{below}")
    if days is not None:
        read = read.where(F.col("day").isin(list(days)))
    landed = with_file_columns(read)
    landed = landed.withColumn("file_source", F.col("source"))
    if "day" in folders:
        landed = landed.withColumn("file_date", F.col("day").cast("date"))
    return landed.drop("year", "day")


def write_canonical(df: DataFrame, path: str, grain: str = "day") -> None:
    """Cleaned panel as Parquet by day, or by year when days are small.

    It is the source for a rebuild.
    """
    folder = "trade_date"
    if grain == "year":
        folder = "year"
        df = df.withColumn("year", F.year("trade_date"))
    with writing_folders(df.sparkSession):
        df.hint("rebalance", folder).write.mode("overwrite").partitionBy(folder).parquet(path)


def export_by_ticker(df: DataFrame, path: str) -> None:
    """One folder of CSV per stock; an export, not a layout to query."""
    with writing_folders(df.sparkSession, "static"):
        (
            df.hint("rebalance", "ticker")
            .sortWithinPartitions("ticker", "trade_date")
            .write.mode("overwrite")
            .partitionBy("ticker")
            .option("header", "true")
            .options(**PLAIN_FILES)
            .csv(path)
        )


def read_by_ticker(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of an ``export_by_ticker``, in the columns and types of ``schema``.

    Files are read whole: a text may hold line ends, and a small file opens faster so. A
    file holds one stock's series, at most a row for each trading day.
    """
    reader = spark.read.option("header", "true").option("multiLine", "true").schema(schema)
    with listing_folders(spark):
        back = reader.csv(path)
    return back.select(*schema.names)


def load_report(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows per file and their total (file_name NULL).

    ``files`` lists expected files, so those without rows appear with 0.
    """
    counts = df.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))
    if files is not None:
        counts = files.select("file_name").join(counts, "file_name", "left").fillna(0, ["n_rows"])
    return counts.rollup("file_name").agg(F.sum("n_rows").alias("n_rows"))


def load_outcome(report: DataFrame, already_loaded: DataFrame) -> DataFrame:
    """Counts of files by outcome: success, skipped (already loaded) or failed (no rows)."""
    done = already_loaded.select("file_name").distinct().withColumn("_known", F.lit(True))
    outcome = (
        F.when(F.col("_known"), "skipped").when(F.col("n_rows") == 0, "failed").otherwise("success")
    )
    return (
        report.where(F.col("file_name").isNotNull())
        .join(done, "file_name", "left")
        .groupBy(outcome.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n_files"))
    )
