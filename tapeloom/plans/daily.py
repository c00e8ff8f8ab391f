"""Cleaning, enriching and loading landed snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import DAILY_MARKET_SNAPSHOT, layout_of
from ..contracts import fixed_values as fixed
from ..functions import dates, limits, tickers
from ..operators import carry, market, quality
from ..operators.keys import best_sources, keep_last, prefer_source
from ..operators.shaping import apply_mapping, conform, stamp
from ..sources import raw_files
from ..sources.store import PANEL, Store

Day = date | str


def _typed_rows(
    raw: DataFrame,
    layout: str,
    sequence: Sequence[str | Column],
    keep: Sequence[str],
    strict_dates: bool,
    suffix: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Contract columns and types, and the helper columns that order the rows."""
    order = [f"_order{i}" for i in range(len(sequence))]
    helpers = dict(zip(order, [F.col(c) if isinstance(c, str) else c for c in sequence]))
    named = apply_mapping(raw.withColumns(helpers), layout, namespace="snapshot")
    if layout == "tushare_daily" and isinstance(named.schema["trade_date"].dataType, T.StringType):
        named = named.withColumn(
            "trade_date", dates.compact_date(F.col("trade_date"), strict_dates)
        )
    shaped = conform(named, DAILY_MARKET_SNAPSHOT, keep=[*order, *keep])
    typed = quality.canonicalize(shaped)
    if suffix:
        typed = typed.withColumn("ticker", tickers.suffix_history(F.col("ticker")))
    return conform(typed, DAILY_MARKET_SNAPSHOT, typed=True, keep=[*order, *keep]), order


def clean_snapshot(
    raw: DataFrame,
    layout: str = fixed.DEFAULT_LAYOUT,
    sequence: Sequence[str | Column] = (raw_files.SEQUENCE,),
    keep: Sequence[str] = (),
    strict_dates: bool = True,
    suffix: bool = False,
) -> DataFrame:
    """Header names, contract columns, types, then the last row of each key.

    ``sequence`` orders the input rows. The compact date of the tushare layout
    must parse unless ``strict_dates`` is off. ``suffix`` brings tickers to the
    suffixed form, so that a change of source does not change them.
    """
    typed, order = _typed_rows(raw, layout, sequence, keep, strict_dates, suffix)
    return keep_last(typed, order).drop(*order)


def clean_sources(
    landed: Mapping[str, DataFrame],
    sequence: Sequence[str | Column] = (raw_files.SEQUENCE,),
    strict_dates: bool = True,
    suffix: bool = False,
) -> DataFrame:
    """Clean each landed source by its layout and keep the best source per day.

    The choice comes before the dedupe, so only rows that stay are shuffled.
    """
    parts = []
    for code, raw in landed.items():
        typed, order = _typed_rows(raw, layout_of(code), sequence, (), strict_dates, suffix)
        parts.append(stamp(typed, source=code))
    chosen = prefer_source(reduce(DataFrame.unionByName, parts))
    return keep_last(chosen, order).drop(*order, "source")


def clean_landing(
    spark: SparkSession,
    path: str,
    sequence: Sequence[str | Column] = (raw_files.SEQUENCE,),
    strict_dates: bool = True,
    suffix: bool = False,
) -> DataFrame:
    """``clean_sources`` of a landing by day and source, chosen before anything is read.

    The folders' names say which source delivered a day, so each source is read for its
    own days alone. One small row per day reaches the driver.
    """
    chosen: dict[str, list[date]] = {}
    for row in best_sources(raw_files.landed_days(spark, path)).collect():
        chosen.setdefault(row.source, []).append(row.trade_date)
    if not chosen:
        raise FileNotFoundError(f"no landed day below {path}")
    parts = []
    for code, own in sorted(chosen.items()):
        raw = raw_files.read_raw(spark, path, code, days=own)
        typed, order = _typed_rows(raw, layout_of(code), sequence, (), strict_dates, suffix)
        parts.append(typed)
    return keep_last(reduce(DataFrame.unionByName, parts), order).drop(*order)


def derive(panel: DataFrame) -> DataFrame:
    """Missing percent change, then ST flag, then limit flags by percent."""
    filled = panel.withColumn(
        "pct_change",
        limits.fill_change_pct(F.col("pct_change"), F.col("close"), F.col("pre_close")),
    )
    return market.flag_limits_by_pct(market.flag_st(filled))


def enrich(
    cleaned: DataFrame,
    history: DataFrame | None = None,
    stored_days: DataFrame | None = None,
    max_gap: int | None = None,
) -> DataFrame:
    """Carry missing stocks forward from ``history`` if given, then derive columns.

    Any number of days at once; see ``carry.carry_forward``.
    """
    if history is not None:
        cleaned = carry.carry_forward(cleaned, history, stored_days, max_gap)
    return derive(cleaned)


def enrich_one_day(cleaned: DataFrame, store: Store, trade_date: Day) -> DataFrame:
    """``enrich`` for one day: reads a single stored partition."""
    before = stamp(
        store.day_before(trade_date), trade_date=F.lit(trade_date).cast("date")
    ).select(*cleaned.columns)
    return derive(carry.carry_missing(cleaned, before))


def daily_update(
    landed: Mapping[str, DataFrame],
    store: Store,
    trade_date: Day,
    raw_path: str | None = None,
    canonical_path: str | None = None,
    sequence: Sequence[str | Column] = (raw_files.SEQUENCE,),
) -> int:
    """Land raw, clean, keep the canonical copy, enrich, replace the day.

    ``landed`` maps source codes to raw rows of the day. Only tushare rows carry
    their date; all others are stamped with the day. Tickers take the suffixed
    form. A delivery without a row of the day is an error and leaves the stored
    day as it is. Returns rows stored.
    """
    day = F.lit(trade_date).cast("date")
    landed = {
        code: df if code == "tushare" else stamp(df, trade_date=day.cast("string"))
        for code, df in landed.items()
    }
    if raw_path:
        for code, df in landed.items():
            text = df.drop(*raw_files.FILE_COLUMNS, raw_files.SEQUENCE)
            raw_files.write_raw(stamp(text, source=code), raw_path)
    cleaned = clean_sources(landed, sequence, suffix=True)
    cleaned = cleaned.where(F.col("trade_date") == day).persist()
    try:
        quality.require_rows(cleaned, f"delivery for {trade_date}")
        if canonical_path:
            raw_files.write_canonical(cleaned, canonical_path)
        return store.replace_day(enrich_one_day(cleaned, store, trade_date), trade_date)
    finally:
        cleaned.unpersist()


def update_days(cleaned: DataFrame, store: Store, max_gap: int | None = None) -> None:
    """Enrich and replace every delivered day, as if loaded in date order."""
    history = store.table(PANEL).select(*cleaned.columns)
    store.replace_days(enrich(cleaned, history, store.days(), max_gap))
