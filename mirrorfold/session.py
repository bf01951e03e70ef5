"""Session helpers: recommended settings, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

# Settings the apply plans rely on. All are SQL settings, so they can be given
# to an existing session too; partition counts are left to the cluster.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Call sites of every column expression cost more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

THREADS = 6  # jobs of one batch that run side by side


def build_session(app: str = "mirrorfold", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or a local one where none is named.

    ``spark.checkpoint.dir`` is what a cluster sets; only a session without it
    (a test on one machine) falls back to a local temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mirrorfold-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unique folder name under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_STAGED: ContextVar[list | None] = ContextVar("staged", default=None)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    staged = df.checkpoint()
    if _STAGED.get() is not None:
        _STAGED.get().append(staged)
    return staged


def drop_staged(staged: DataFrame) -> None:
    """Deletes the files of a frame that :func:`cut_lineage` returned, which nothing reads any more."""
    spark = staged.sparkSession
    found = staged._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if found.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staged_dropped() -> Iterator[None]:
    """The files of what :func:`cut_lineage` stages within, in this thread, go at the end. For
    frames that are written before it."""
    token = _STAGED.set([])
    try:
        yield
    finally:
        made = _STAGED.get()
        _STAGED.reset(token)
        for staged in made:
            drop_staged(staged)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The SQL setting holds within, for what runs there; the session's own is put back after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Within, the shuffle files of a query go when the query ends, not when the driver next collects
    garbage. For plans whose every step is written and reread."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int = 1000):
    """Within, Python workers get and hold so many rows at a time. For rows of many kilobytes."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def any_row(df: DataFrame) -> Row | None:
    """Action. A row of ``df``, or None. All partitions are looked at side by side: where there
    is none, as in a check that holds, ``first`` sees them all too, one, then four, and so on."""
    return df.agg(F.first(F.struct(*[F.col(c) for c in df.columns])).alias("row")).first()["row"]


def together(tasks: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Action. Runs jobs that do not need each other side by side, and gives
    what each returned. Where some fail, the first of them in order is raised."""
    with ThreadPoolExecutor(THREADS) as pool:
        running = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: run.result() for name, run in running.items()}
