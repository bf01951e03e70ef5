"""Freshness and load reports over commit, visibility and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirrorfold.functions.positions import millis_between
from mirrorfold.operators.ordered import running_sums

# The reported nearest-rank percentiles.
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def nearest_rank(value: str, by: list[str], df: DataFrame) -> DataFrame:
    """Count, nearest-rank percentiles and maximum of ``value`` per group.

    Equal values are counted first, so what is ordered is the distinct values of
    a group, and the order itself is cut into ranges.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counted, [value], {"_upto": F.col("_n")}, keys=by)
    total = run.groupBy(*by).agg(F.max("_upto").alias("count"))
    joined = run.join(total, by) if by else run.withColumn("count", total.scalar())
    picks = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("count") * F.lit(p)), F.col(value))).alias(name)
             for name, p in PERCENTILES.items()]
    return joined.groupBy(*by, "count").agg(*picks, F.max(value).alias("max"))


def visibility_latency(commits: DataFrame, visible: DataFrame) -> DataFrame:
    """Per committed row: milliseconds from commit to first seen in the report,
    null while it is pending."""
    seen = visible.groupBy("id").agg(F.min("visible_at").alias("visible_at"))
    return (commits.join(seen, "id", "left")
            .withColumn("latency_ms", F.when(F.col("visible_at").isNotNull(), millis_between(
                F.col("committed_at"), F.col("visible_at")))))


def pending(commits: DataFrame, visible: DataFrame) -> DataFrame:
    return commits.join(visible.select("id"), "id", "left_anti")


def observed(commits: DataFrame, visible: DataFrame) -> DataFrame:
    """Pending rows that are visible now (the intersection on the key)."""
    return commits.join(visible.select("id"), "id", "left_semi")


def _backlog_steps(commits: DataFrame, visible: DataFrame) -> DataFrame:
    """Net change of the backlog per instant; a row that commits at the instant
    another becomes visible counts with it, hence arrivals first."""
    ups = commits.select(F.col("committed_at").alias("at"), F.lit(0).alias("leaving"))
    downs = (commits.select("id").join(visible.groupBy("id").agg(F.min("visible_at").alias("at")), "id")
             .select("at", F.lit(1).alias("leaving")))
    return ups.unionByName(downs).groupBy("at", "leaving").agg(F.count(F.lit(1)).alias("_n"))


def backlog(commits: DataFrame, visible: DataFrame) -> DataFrame:
    """The backlog after each step: ``(at, leaving, pending)``."""
    delta = F.when(F.col("leaving") == 0, F.col("_n")).otherwise(-F.col("_n"))
    return running_sums(_backlog_steps(commits, visible), ["at", "leaving"], {"pending": delta}).drop("_n")


def peak_backlog(commits: DataFrame, visible: DataFrame) -> DataFrame:
    """The largest number of rows committed and not yet visible."""
    return backlog(commits, visible).agg(F.max("pending").alias("peak_pending"))


def backlog_per(commits: DataFrame, visible: DataFrame, bucket: Column) -> DataFrame:
    """Pending rows at the end of each time bucket (``bucket`` of column ``at``)."""
    last = F.max_by("pending", F.struct("at", "leaving")).alias("pending")
    return backlog(commits, visible).groupBy(bucket.alias("bucket")).agg(last)


def failures_by_stage(requests: DataFrame, by: list[str]) -> DataFrame:
    return (requests.filter(~F.col("ok")).groupBy(*by, "failed_stage")
            .agg(F.count(F.lit(1)).cast("bigint").alias("failures")))


def load_summary(requests: DataFrame, profiles: DataFrame, rejected_stage: str) -> DataFrame:
    """Per offered rate: how many flows were planned, started, done and failed,
    and successes per offered and per wall second. ``profiles`` has one row per
    rate with its duration and wall seconds."""
    counted = requests.groupBy("rate").agg(
        F.sum(F.when(F.col("ok"), 1).otherwise(0)).cast("bigint").alias("successful"),
        F.sum(F.when(~F.col("ok"), 1).otherwise(0)).cast("bigint").alias("failed"),
        F.sum(F.when(F.col("failed_stage").eqNullSafe(rejected_stage), 1).otherwise(0)).cast("bigint")
        .alias("rejected"), F.count(F.lit(1)).cast("bigint").alias("flows"))
    joined = profiles.join(counted, "rate", "left")
    per = lambda n, d: F.round(F.when(d > 0, n / d).otherwise(0.0), 3)
    return joined.select(
        "rate", (F.col("rate") * F.col("duration_seconds")).cast("bigint").alias("scheduled"), "flows", "successful",
        "failed", "rejected", (F.col("flows") - F.col("rejected")).alias("started"),
        per(F.col("successful"), F.col("duration_seconds")).alias("per_offered_second"),
        per(F.col("successful"), F.col("wall_seconds")).alias("per_wall_second"))
