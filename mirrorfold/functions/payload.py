"""Reading change payloads (VARIANT) without confusing absent with null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed value: JSON timestamps keep microseconds and the zone.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}


def has_field(payload: Column, name: str) -> Column:
    """True when the key is present, also when its value is JSON null."""
    return F.try_variant_get(payload, f"$.{name}", "variant").isNotNull()


def field(payload: Column, name: str, kind: T.DataType) -> Column:
    """The typed value; a value that does not fit the type raises."""
    return F.variant_get(payload, f"$.{name}", kind.simpleString())


def try_field(payload: Column, name: str, kind: T.DataType | str) -> Column:
    kind = kind if isinstance(kind, str) else kind.simpleString()
    return F.try_variant_get(payload, f"$.{name}", kind)


def row_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), JSON_OPTIONS)


def typed_row(text: Column, schema: T.StructType) -> Column:
    return F.from_json(text, schema, {"timestampFormat": TIMESTAMP_FORMAT})
