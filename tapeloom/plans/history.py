"""Deriving whole histories from bare bars, all tickers in one windowed job."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import fixed_values as fixed
from ..functions import dates
from ..operators import series
from ..operators.shaping import add_absent, in_order, rename_headers

OPTIONAL = {
    "amount": "double", "turnover": "double", "market_cap": "double", "float_cap": "double"
}


def derive_history(
    bars: DataFrame,
    start: date | str | None = None,
    mapping: Mapping[str, str] = fixed.HISTORY_MAPPING,
) -> DataFrame:
    """History columns with previous close and percent change.

    Rows without a readable date go, the series starts at ``start``, and each
    ticker's first row, having no previous close, is dropped.
    """
    named = add_absent(rename_headers(bars, mapping), OPTIONAL)
    if dict(named.dtypes)["trade_date"] == "string":
        named = named.withColumn(
            "trade_date", dates.parse_date(F.col("trade_date"), with_time=True)
        )
    dated = named.dropna(subset=["trade_date"])
    return in_order(series.derive_changes(dated, start), fixed.HISTORY_COLUMNS)
