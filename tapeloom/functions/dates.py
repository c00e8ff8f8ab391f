"""Date expressions. Days parse by ``try_cast``, without an exception per bad row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import fixed_values as fixed
from .tickers import BLANKS

# dashed, slashed or compact day; groups 1, 3 + 5 and 4 + 6 are year, month, day
_DAY = r"(\d{4})(?:([-/])(\d{1,2})\2(\d{1,2}){time}|(\d{2})(\d{2}))"
_TIME = r"(?:[ T](?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d+)?)?)?"
_COMPACT = r"(\d{4})()(\d{2})(\d{2})()()"


def _rewritten(text: Column, shape: str) -> Column:
    """Dashed form of a text of ``shape`` and NULL for any other.

    One rewrite and one cast: the text appears once in the expression, so nothing
    is evaluated twice when Catalyst inlines or pushes it down.
    """
    whole = rf"(?s)^[{BLANKS}]*{shape}[{BLANKS}]*$|^.*$"
    return F.regexp_replace(text.cast("string"), whole, "$1-$3$5-$4$6").try_cast("date")


def spark_pattern(strftime_format: str, lenient: bool = False) -> str:
    """Translate a strftime format; ``lenient`` accepts unpadded month and day
    where a separator follows or precedes them."""
    tokens = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}
    adjacent = re.search(r"%[A-Za-z]%[A-Za-z]", strftime_format) is not None
    if lenient and not adjacent:
        tokens.update({"m": "M", "d": "d", "H": "H", "M": "m", "S": "s"})

    def swap(match):
        if match.group(1) not in tokens:
            raise ValueError(f"unsupported date token %{match.group(1)}")
        return tokens[match.group(1)]

    return re.sub(r"%([A-Za-z])", swap, strftime_format)


def parse_date(text: Column, from_format: str | None = None, with_time: bool = False) -> Column:
    """Text to date, NULL when it does not fit.

    Without a format the dashed, compact and slashed forms are tried.
    ``with_time`` also takes a dashed date followed by a time of day.
    """
    if from_format:
        return F.try_to_timestamp(
            text.cast("string"), F.lit(spark_pattern(from_format, lenient=True))
        ).cast("date")
    return _rewritten(text, _DAY.replace("{time}", _TIME if with_time else ""))


def format_date(
    text: Column,
    from_format: str | None = None,
    to_format: str = fixed.DATE_FORMAT,
    strict: bool = True,
) -> Column:
    """Re-format a date text; an unreadable value is an error unless ``strict`` is off."""
    day = parse_date(text, from_format)
    shown = F.date_format(day, spark_pattern(to_format))
    if not strict:
        return shown
    unread = text.isNotNull() & day.isNull()
    return F.when(
        unread, F.raise_error(F.concat(F.lit("cannot read date: "), text)).cast("string")
    ).otherwise(shown)


def compact_date(text: Column, strict: bool = True) -> Column:
    """``yyyyMMdd`` to date; raises on a bad value unless ``strict`` is off."""
    day = _rewritten(text, _COMPACT)
    if not strict:
        return day
    unread = text.isNotNull() & day.isNull()
    return F.when(
        unread,
        F.raise_error(F.concat(F.lit("not a yyyyMMdd date: "), text.cast("string"))).cast("date"),
    ).otherwise(day)


def day_only(moment: Column) -> Column:
    return moment.cast("date")


def iso_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def market_time(moment: Column, source_zone: str | None = None) -> Column:
    """Wall-clock time of the market.

    A TIMESTAMP is an instant and needs no ``source_zone``; for a TIMESTAMP_NTZ
    name the zone its values are written in.
    """
    source = F.lit(source_zone) if source_zone else F.current_timezone()
    return F.convert_timezone(source, F.lit(fixed.MARKET_ZONE), moment)


def effective_date(
    moment: Column, close_time: str = fixed.MARKET_CLOSE, source_zone: str | None = None
) -> Column:
    """Market date of an instant, one day earlier while the market is still open."""
    hour, minute = (int(part) for part in close_time.split(":"))
    local = market_time(moment, source_zone)
    open_still = (F.hour(local) * 60 + F.minute(local)) < (hour * 60 + minute)
    return F.when(open_still, F.date_sub(local.cast("date"), 1)).otherwise(local.cast("date"))
