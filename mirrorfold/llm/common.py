"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Rows of one Arrow batch that a Python function sees at once.
CHUNK = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], added: list[T.StructField],
              text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with the columns ``added`` behind them.

    ``make()`` runs once in each task and returns a function from the texts of
    a chunk of rows (null: empty) to one Arrow array per added column. Rows
    keep their other values untouched, so nothing has to be joined back.
    """
    schema = T.StructType([*df.schema.fields, *added])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                arrays = function([x or "" for x in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *arrays], names=[*part.schema.names, *[f.name for f in added]])

    return df.mapInArrow(run, schema)
