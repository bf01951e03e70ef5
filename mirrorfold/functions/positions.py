"""Log positions and time differences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_position(text: Column) -> Column:
    """``HI/LO`` in hexadecimal to one BIGINT, ``hi * 2**32 + lo``."""
    high = F.conv(F.substring_index(text, "/", 1), 16, 10).cast("bigint")
    low = F.conv(F.substring_index(text, "/", -1), 16, 10).cast("bigint")
    return F.shiftleft(high, 32) + low


def format_position(position: Column) -> Column:
    low = position.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.concat(F.hex(F.shiftright(position, 32)), F.lit("/"), F.hex(low))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end``, never below zero."""
    return F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("MILLISECOND", start, end))
