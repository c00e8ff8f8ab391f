"""DataFrame -> DataFrame steps."""

from . import calendar, carry, keys, market, quality, series, shaping

__all__ = ["calendar", "carry", "keys", "market", "quality", "series", "shaping"]
