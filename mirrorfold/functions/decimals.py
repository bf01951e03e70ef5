"""Exact money: a value either fits its decimal type or is refused."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The wide type a number is parsed to before it is compared with
# its narrow form, and the most fraction digits that type can hold.
WIDE_PRECISION, WIDE_SCALE = 38, 10
WIDE = T.DecimalType(WIDE_PRECISION, WIDE_SCALE)
LONG_FRACTION = r"\.[0-9]{%d,}" % (WIDE_SCALE + 1)


def fits(value: Column, kind: T.DecimalType) -> Column:
    """False when a cast to ``kind`` would round or overflow; null fits."""
    wide = value.try_cast(WIDE)
    narrow = value.try_cast(kind)
    return value.isNull() | F.coalesce(narrow.cast(WIDE) == wide, F.lit(False))


def text_fits(text: Column, kind: T.DecimalType) -> Column:
    """As :func:`fits` for number text, also refusing very long fractions."""
    return fits(text, kind) & ~F.coalesce(text.rlike(LONG_FRACTION), F.lit(False))
