"""Session defaults and shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapeloom", master: str | None = None, **conf) -> SparkSession:
    """A session with what the jobs rely on; cluster settings are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A new folder path below a folder that the driver and all executors share.

    That folder is ``base`` if given, else what ``spark.checkpoint.dir`` names, else
    the warehouse.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Set session settings (``__`` for a dot) and put the old values back after."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Shuffle files go when the job that made them ends, not when the driver next collects garbage.
RELEASED = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


@contextmanager
def kept_rows(rows: DataFrame, folder: str) -> Iterator[DataFrame]:
    """Rows written once to a new ``folder`` and read from there; gone afterwards.

    For rows taken several times. Unlike a cache it holds no memory, nor the shuffle files of
    what made the rows, and plans built on it begin at files.
    """
    spark = rows.sparkSession
    try:
        with settings(spark, **RELEASED):
            rows.write.parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def writing_folders(spark: SparkSession, mode: str = "dynamic"):
    """Settings for writes into many folders.

    Tasks are not merged by size: a long history of small days is bound by the
    number of files opened, not by bytes. Large days are still split.
    """
    return settings(
        spark,
        spark__sql__sources__partitionOverwriteMode=mode,
        spark__sql__adaptive__coalescePartitions__enabled="false",
        **RELEASED,
    )


def listing_folders(spark: SparkSession):
    """Settings for reads of many files or folders: as many listing tasks as a shuffle has.

    Spark's own choice is a task for each folder up to 10,000, and starting those takes
    longer than the listing.
    """
    return settings(
        spark,
        spark__sql__sources__parallelPartitionDiscovery__parallelism=spark.conf.get(
            "spark.sql.shuffle.partitions"
        ),
    )
