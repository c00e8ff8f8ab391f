"""Renaming, conforming and ordering of columns. Metadata only: no job, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import TableContract, get_mapping
from ..functions import numbers


def rename_headers(
    df: DataFrame, mapping: Mapping[str, str], drop_extra: bool = False
) -> DataFrame:
    renamed = df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
    if not drop_extra:
        return renamed
    wanted = set(mapping.values())
    return renamed.select(*[c for c in renamed.columns if c in wanted])


def apply_mapping(
    df: DataFrame, source: str, drop_extra: bool = False, namespace: str = "contract"
) -> DataFrame:
    """Source headers to contract names; unknown columns stay unless ``drop_extra``."""
    return rename_headers(df, get_mapping(source, namespace), drop_extra)


def conform(
    df: DataFrame,
    contract: TableContract,
    typed: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Contract columns in contract order; absent ones become NULL, others go.

    ``typed`` also casts to the contract's types with the store's rounding rules.
    ``keep`` names helper columns to carry along at the end.
    """
    present = dict(df.dtypes)

    def pick(field: T.StructField) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if typed and df.schema[field.name].dataType != field.dataType:
            value = to_type(value, df.schema[field.name].dataType, field.dataType)
        return value.alias(field.name)

    return df.select(*[pick(f) for f in contract.schema.fields], *keep)


def to_type(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """Cast as the store does on insert: reals are rounded, not cut, to whole numbers."""
    if isinstance(want, T.IntegralType) and not isinstance(have, T.IntegralType):
        return numbers.to_whole(value.cast("double")).cast(want)
    return value.cast(want)


def add_absent(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add each missing column of ``{name: type}`` as NULL."""
    return df.withColumns(
        {
            name: F.lit(None).cast(dtype)
            for name, dtype in columns.items()
            if name not in df.columns
        }
    )


def in_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def stamp(df: DataFrame, **constants) -> DataFrame:
    """Add constant columns such as ``ticker`` or ``trade_date``."""
    return df.withColumns(
        {k: v if isinstance(v, Column) else F.lit(v) for k, v in constants.items()}
    )
