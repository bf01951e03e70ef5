"""Consumer views: explicit columns over an owner's tables, read only, never cached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirrorfold.contracts import CONSUMER_VIEWS, contract
from mirrorfold.errors import Refused
from mirrorfold.operators.readmodels import project_columns
from mirrorfold.sources.store import Store


def create_views(spark: SparkSession, owner: str, consumers: list[str] | None = None) -> list[str]:
    """Action. ``<consumer>.<table>`` as a view over the catalog table
    ``<owner>.<table>``. A query begun after a commit of the owner sees it.

    A name that is a table already is refused: a read model has no copy that
    could be written.
    """
    created = []
    for consumer in consumers or sorted(CONSUMER_VIEWS):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{consumer}`")
        for table in CONSUMER_VIEWS[consumer]:
            name = f"{consumer}.{table}"
            if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
                raise Refused("read_only", f"{name} exists as a writable table")
            c = contract(table)
            if c.key not in c.columns:
                raise Refused("read_only", f"{name} would lose its key")
            columns = ", ".join(f"`{column}`" for column in c.columns)
            spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM `{owner}`.`{table}`")
            created.append(name)
    return created


def read_store(store: Store, statement: str) -> DataFrame:
    """The answer of a SQL statement over the newest manifest: mirrors and
    report are there under their names, all of one version, and a commit
    between two calls is seen by the second."""
    manifest = store.require()
    for name in manifest["published"]["tables"]:
        store.table(name, manifest).createOrReplaceTempView(name)
    return store.spark.sql(statement)


def temporary_views(tables: dict[str, DataFrame], consumers: list[str] | None = None) -> list[str]:
    """The same for a session only, named ``<consumer>_<table>``."""
    created = []
    for consumer in consumers or sorted(CONSUMER_VIEWS):
        for table in CONSUMER_VIEWS[consumer]:
            name = f"{consumer}_{table}"
            project_columns(tables[table], table).createOrReplaceTempView(name)
            created.append(name)
    return created
