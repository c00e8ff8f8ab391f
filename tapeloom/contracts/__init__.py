"""Table contracts, field groups and header mappings."""

from .mappings import build_custom_mapping, get_mapping, layout_of
from .tables import (
    ALL_TABLES,
    DAILY_MARKET_SNAPSHOT,
    MARKET_PHASE,
    NOTES,
    TABLE_BY_NAME,
    TRADE_EXECUTION,
    TableContract,
    get_table,
)

__all__ = [
    "ALL_TABLES", "DAILY_MARKET_SNAPSHOT", "MARKET_PHASE", "NOTES", "TABLE_BY_NAME",
    "TRADE_EXECUTION", "TableContract", "build_custom_mapping", "get_mapping",
    "get_table", "layout_of",
]
