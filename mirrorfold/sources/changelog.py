"""The change log as files of JSON lines, or as messages of a topic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrorfold.contracts import ENVELOPE
from mirrorfold.functions.payload import TIMESTAMP_FORMAT

# A malformed line stops the run; it is never dropped or read as nulls.
JSON_READ = {"mode": "FAILFAST", "timestampFormat": TIMESTAMP_FORMAT}


def read_change_log(spark: SparkSession, paths: str | list[str], streaming: bool = False,
                    files_per_trigger: int | None = None) -> DataFrame:
    """One log over one folder, or several (one per source) read as one."""
    folders = [paths] if isinstance(paths, str) else paths
    parts = []
    for folder in folders:
        reader = (spark.readStream if streaming else spark.read).schema(ENVELOPE).options(**JSON_READ)
        if streaming and files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        parts.append(reader.json(folder))
    return reduce(DataFrame.unionByName, parts)


def read_change_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """The same envelope from a Kafka topic (needs Spark's Kafka connector)."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    raw = reader.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    parsed = F.from_json(F.col("value").cast("string"), ENVELOPE, JSON_READ)
    return raw.select(parsed.alias("m")).select("m.*")


def write_change_log(log: DataFrame, folder: str) -> None:
    """Action. Appends envelope rows as JSON lines."""
    log.write.mode("append").options(timestampFormat=TIMESTAMP_FORMAT, ignoreNullFields="true").json(folder)
