"""Whole-table scans with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrorfold.contracts import contract
from mirrorfold.functions.payload import row_json


def snapshot(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Tables read with their contract's schema (nothing inferred), its columns only."""
    return {name: spark.read.schema(contract(name).schema).parquet(path).select(*contract(name).columns)
            for name, path in paths.items()}


def snapshot_jdbc(spark: SparkSession, url: str, tables: dict[str, str], splits: dict[str, list[str]],
                  **options: str) -> dict[str, DataFrame]:
    """The same from a database. ``splits`` are ascending key bounds per table;
    each range between two bounds is read by its own task."""
    out = {}
    for name, relation in tables.items():
        c = contract(name)
        bounds = splits.get(name, [])
        quoted = [b.replace("'", "''") for b in bounds]
        ranges = ([f"{c.key} < '{quoted[0]}'"]
                  + [f"{c.key} >= '{a}' and {c.key} < '{b}'" for a, b in zip(quoted, quoted[1:])]
                  + [f"{c.key} >= '{quoted[-1]}'"]) if quoted else None
        frame = spark.read.jdbc(url, relation, predicates=ranges, properties=options) if ranges else \
            spark.read.jdbc(url, relation, properties=options)
        out[name] = frame.select(*c.columns)
    return out


def as_changes(df: DataFrame, name: str, action: str = "I") -> DataFrame:
    """Rows of a table as changes: ``(table_name, row_id, action, payload)``."""
    c = contract(name)
    return df.select(F.lit(name).alias("table_name"), F.col(c.key).alias("row_id"), F.lit(action).alias("action"),
                     row_json(c.columns).alias("payload"))
