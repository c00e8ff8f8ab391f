"""Column expressions: tickers, dates, numbers, limits."""

from . import dates, limits, numbers, tickers

__all__ = ["dates", "limits", "numbers", "tickers"]
