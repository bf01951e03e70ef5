"""Text rules: trimming, blanks, byte sizes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space is every Unicode white-space character, an
# identifier is 36 characters of hexadecimal digits in 8-4-4-4-12 groups.
EDGE_SPACE = r"(?U)^\s+|\s+$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, EDGE_SPACE, "")


def is_blank(value: Column) -> Column:
    return value.isNull() | (trimmed(value) == "")


def default_if_blank(value: Column, default: str) -> Column:
    return F.when(is_blank(value), F.lit(default)).otherwise(trimmed(value))


def utf8_bytes(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")


def utf16_bytes(value: Column) -> Column:
    return F.octet_length(F.encode(value, "UTF-16LE")).cast("bigint")


def utf16_length(value: Column) -> Column:
    return F.shiftright(utf16_bytes(value), 1)


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID_PATTERN), F.lit(False))


def normal_id(value: Column) -> Column:
    """Identifiers compare in lower case; other text is left alone."""
    return F.when(is_uuid(value), F.lower(value)).otherwise(value)


def stable_id(*parts: Column) -> Column:
    """An identifier derived from a natural key, the same on every replay."""
    digest = F.sha2(F.concat_ws("\u001f", *parts), 256)
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)
