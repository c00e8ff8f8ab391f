"""Number and boolean conversions, and exact sums (Column -> Column)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import fixed_values as fixed
from .tickers import strip

# no numbers: not-a-number, and forms only Java reads as numbers (1.5f, 0x1p3)
_NO_NUMBER = r"(?is)^(?:[+-]?nan|.*[0-9.][fd]|.*x.*)$"


def no_nan(value: Column) -> Column:
    """NaN means missing. Spark orders NaN above every number, so it must not stay."""
    return F.when(~F.isnan(value), value)


def to_number(value: Column, dtype: T.DataType | None = None, errors: str = "coerce") -> Column:
    """To double; what is not a number becomes NULL, or an error with ``errors='raise'``.

    ``dtype`` is the column's present type when known: numeric columns then skip
    the text rules.
    """
    if errors not in ("coerce", "raise"):
        raise ValueError(f"errors must be 'coerce' or 'raise', not {errors!r}")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return no_nan(value.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    text = strip(value.cast("string"))
    number = F.regexp_replace(text, _NO_NUMBER, "").try_cast("double")
    if errors == "raise":
        bad = (F.regexp_replace(text, r"(?i)^[+-]?nan$", "") != "") & number.isNull()
        number = F.when(
            bad, F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")
        ).otherwise(number)
    return number


def to_whole(value: Column) -> Column:
    """Double to bigint by rounding half to even; out of range becomes NULL."""
    return F.rint(value).try_cast("bigint")


def to_boolean(
    value: Column,
    true_words: Iterable[str] | None = None,
    false_words: Iterable[str] | None = None,
) -> Column:
    """Words to boolean; a value in neither list is NULL."""
    text = value.cast("string")
    return F.when(text.isin(*(true_words or fixed.TRUE_WORDS)), True).when(
        text.isin(*(false_words or fixed.FALSE_WORDS)), False
    )


def scaled(value: Column, places: int = fixed.DECIMAL_PLACES) -> Column:
    """Value as a whole number of ``10**-places`` units."""
    return F.rint(value * F.lit(float(10**places))).cast("bigint")


def exact_sum(value: Column, places: int = fixed.DECIMAL_PLACES) -> Column:
    """Sum to ``places`` decimals, independent of row order and of task retries."""
    total = F.sum(scaled(value, places).cast("decimal(19,0)"))
    return total.cast("double") / F.lit(float(10**places))


_LIMB = 31


def limbs(value: Column) -> tuple[Column, Column, Column]:
    """A double as three whole numbers of its sign: its whole part, and 62 binary places in
    two parts.

    Powers of two scale without rounding, so this is exact for every double that is a
    multiple of 2**-62, which are all of at least 2**-9 in size. Sums of each part are exact, too.
    """
    def cut(x: Column) -> Column:
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))

    scale = F.lit(float(1 << _LIMB))
    upper = (value - cut(value).cast("double")) * scale
    return cut(value), cut(upper), cut((upper - cut(upper).cast("double")) * scale)


def from_limbs(whole: Column, upper: Column, lower: Column) -> Column:
    """The double that summed limbs stand for, by size and sign so that no place is lost."""
    mask = (1 << _LIMB) - 1

    def carried(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
        b = b + F.shiftright(c, _LIMB)
        return a + F.shiftright(b, _LIMB), F.shiftleft(b.bitwiseAND(mask), _LIMB).bitwiseOR(c.bitwiseAND(mask))

    sign = F.when(carried(whole, upper, lower)[0] < 0, -1).otherwise(1)
    size, places = carried(whole * sign, upper * sign, lower * sign)
    return sign * (size.cast("double") + places.cast("double") / F.lit(float(1 << 2 * _LIMB)))
