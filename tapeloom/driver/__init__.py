"""Registered queries over the driver's tables, each with the SQL it must equal."""

from . import cleaning_queries, market_queries, panel_queries, store_queries, whole_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
