"""Key-based steps: keep-last, duplicate detection, membership, source priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import fixed_values as fixed

PANEL_KEY = ("trade_date", "ticker")


def keep_last(
    df: DataFrame, sequence: Sequence[str | Column], keys: Sequence[str] = PANEL_KEY
) -> DataFrame:
    """One row per key: the last by ``sequence``.

    Spark turns ``row_number() = 1`` into a group limit that already runs before
    the shuffle, so a key with any number of copies sends at most one row per
    task.
    """
    latest = Window.partitionBy(*keys).orderBy(
        *[(c if isinstance(c, Column) else F.col(c)).desc() for c in sequence]
    )
    return (
        df.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    """Keys held by more than one row, with ``n_rows``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def with_keys_in(df: DataFrame, other: DataFrame, keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def with_keys_not_in(
    df: DataFrame, other: DataFrame, keys: Sequence[str] = PANEL_KEY
) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def missing_tickers(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Tickers of ``previous`` that ``current`` lacks, each once."""
    named = previous.where(F.col("ticker").isNotNull()).select("ticker")
    return named.subtract(current.select("ticker"))


def source_rank(source: Column, priority: Sequence[str] = fixed.SOURCE_PRIORITY) -> Column:
    rank = F.lit(len(priority))
    for position in range(len(priority) - 1, -1, -1):
        rank = F.when(source == priority[position], position).otherwise(rank)
    return rank


def prefer_source(
    df: DataFrame,
    source: str = "source",
    priority: Sequence[str] = fixed.SOURCE_PRIORITY,
) -> DataFrame:
    """Per trade date keep the rows of the best source that delivered any.

    The best rank is aggregated per date first; that result holds one row per
    trading day, which bounds the broadcast. The rows themselves do not move.
    """
    ranked = df.withColumn("_rank", source_rank(F.col(source), priority))
    best = ranked.groupBy("trade_date").agg(F.min("_rank").alias("_rank"))
    return ranked.join(F.broadcast(best), ["trade_date", "_rank"], "left_semi").drop("_rank")


def best_sources(
    delivered: DataFrame, priority: Sequence[str] = fixed.SOURCE_PRIORITY
) -> DataFrame:
    """(trade_date, source) pairs whose source is the best that delivered that date.

    Sources outside the priority rank last, alike, and all stay.
    """
    ranked = delivered.select("trade_date", "source").distinct().withColumn(
        "_rank", source_rank(F.col("source"), priority))
    best = ranked.groupBy("trade_date").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["trade_date", "_rank"]).select("trade_date", "source")
