"""Table contracts: a Spark schema with its key and partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableContract:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    partition_by: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def column_names(self) -> tuple[str, ...]:
        return tuple(self.columns)

    def create_sql(
        self,
        table: str | None = None,
        location: str | None = None,
        period: str | None = None,
        mark: str | None = None,
    ) -> str:
        """``CREATE TABLE IF NOT EXISTS`` for a Parquet table.

        Parquet tables hold no key constraint; ``operators.quality`` and the
        store's checked append guard the key. ``period`` names a text column to
        partition a partitioned contract by instead of its own column; ``mark`` a
        boolean column beside the contract's.
        """
        fields = []
        for field in self.schema.fields:
            line = f"`{field.name}` {field.dataType.simpleString()}"
            if field.name == "created_at":
                line += " DEFAULT current_timestamp()"
            fields.append(line)
        if mark:
            fields.append(f"`{mark}` boolean")
        partition_by = self.partition_by
        if partition_by and period:
            fields.append(f"`{period}` string")
            partition_by = (period,)
        sql = f"CREATE TABLE IF NOT EXISTS {table or self.name} ({', '.join(fields)}) USING parquet"
        if partition_by:
            sql += f" PARTITIONED BY ({', '.join(partition_by)})"
        if location:
            sql += f" LOCATION '{location}'"
        return sql


_DATE, _TEXT, _REAL = T.DateType(), T.StringType(), T.DoubleType()
_INT, _WHOLE, _FLAG, _TIME = T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _contract(name, key, columns, partition_by=()):
    fields = [T.StructField(column, dtype, column not in key) for column, dtype in columns]
    return TableContract(name, T.StructType(fields), key, partition_by)


# --- fixed values: columns in order ------------------------------------------

DAILY_MARKET_SNAPSHOT = _contract(
    "daily_market_snapshot",
    ("trade_date", "ticker"),
    [
        ("trade_date", _DATE),
        ("ticker", _TEXT),
        ("name", _TEXT),
        ("open", _REAL),
        ("high", _REAL),
        ("low", _REAL),
        ("close", _REAL),
        ("pct_change", _REAL),
        ("pre_close", _REAL),
        ("volume", _WHOLE),
        ("amount", _REAL),
        ("turnover", _REAL),
        ("market_cap", _REAL),
        ("float_cap", _REAL),
        ("is_st", _FLAG),
        ("is_limit_up", _FLAG),
        ("is_limit_down", _FLAG),
        ("created_at", _TIME),
    ],
    partition_by=("trade_date",),
)

MARKET_PHASE = _contract(
    "market_phase",
    ("trade_date",),
    [
        ("trade_date", _DATE),
        ("phase", _TEXT),
        ("M1_core", _FLAG),
        ("M2_front", _FLAG),
        ("M3_identifiable", _FLAG),
        ("V_triggered", _FLAG),
        ("notes", _TEXT),
        ("created_at", _TIME),
    ],
)

TRADE_EXECUTION = _contract(
    "trade_execution",
    ("trade_id",),
    [
        ("trade_id", _TEXT),
        ("ticker", _TEXT),
        ("entry_date", _DATE),
        ("entry_price", _REAL),
        ("path_type", _TEXT),
        ("half_sell_trigger", _REAL),
        ("half_sell_date", _DATE),
        ("half_sell_price", _REAL),
        ("exit_date", _DATE),
        ("exit_price", _REAL),
        ("position_pct", _REAL),
        ("notes", _TEXT),
    ],
)

NOTES = _contract(
    "notes",
    ("id",),
    [
        ("id", _INT),
        ("trade_date", _DATE),
        ("scope", _TEXT),
        ("key", _TEXT),
        ("content", _TEXT),
        ("created_at", _TIME),
    ],
)

ALL_TABLES = (DAILY_MARKET_SNAPSHOT, MARKET_PHASE, TRADE_EXECUTION, NOTES)
TABLE_BY_NAME = {contract.name: contract for contract in ALL_TABLES}


def get_table(name: str) -> TableContract:
    try:
        return TABLE_BY_NAME[name]
    except KeyError:
        raise ValueError(f"no contract named {name!r}; known: {sorted(TABLE_BY_NAME)}") from None
