"""Running values in log order, without one task holding a whole order.

A plain unpartitioned window moves every row to one task, and a window per key
does the same to a hot key. So the rows are staged once, dealt out by Spark's
range partitioning into as many ranges as their number asks for, each with its
number as a column. Sums and last values are computed inside each range in
parallel, and a carry, one small row per range and key, links the ranges. It
is the same path for any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mirrorfold.session import cut_lineage, drop_staged

RANGE_ROWS = 1_000_000  # rows aimed at in a range
BLOCK = 1_000  # ranges whose totals are added up together
RANGE = "_range"


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """Action. ``df`` staged in ranges that follow ``order``, with their number.
    Equal values of ``order`` share a range; nulls come first, as in a window.

    Without ``ranges`` the frame is staged once before and counted there, so it
    is computed once; what fits one range stays as it was staged.
    """
    first = None
    if ranges is None:
        df = first = cut_lineage(df)
        ranges = max(1, -(-df.count() // RANGE_ROWS))
        if ranges == 1:
            return df.withColumn(RANGE, F.lit(0))
    ranged = cut_lineage(df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id()))
    if first is not None:
        drop_staged(first)
    return ranged


def _with_carry(local: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    """``local`` with the carry of its key and range; a null key is a key."""
    names = {k: f"_k_{k}" for k in [*keys, RANGE]}
    other = carry.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(name)) for k, name in names.items()]
    # A hot key has many rows on one side of this join alone, so it can be split.
    return local.join(other, same, "left").drop(*names.values())


def _sums_before(totals: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """From totals ``_t_*`` per key and range to ``_c_*``, the sums of the ranges before."""
    zero = F.lit(0).cast("bigint")

    def before(column, *parts, order):
        here = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(here), zero)

    if keys:
        return totals.select(*keys, RANGE, *[before(f"_t_{n}", *keys, order=RANGE).alias(f"_c_{n}") for n in names])
    blocked = totals.withColumn("_block", F.floor(F.col(RANGE) / BLOCK))
    blocks = blocked.groupBy("_block").agg(*[F.sum(f"_t_{n}").alias(f"_b_{n}") for n in names])
    # One row per thousand ranges, that is per thousand million rows.
    ahead = blocks.select("_block", *[before(f"_b_{n}", F.lit(0), order="_block").alias(f"_a_{n}") for n in names])
    return blocked.join(ahead, "_block").select(
        RANGE, *[(before(f"_t_{n}", "_block", order=RANGE) + F.col(f"_a_{n}")).alias(f"_c_{n}") for n in names])


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], keys: list[str] | None = None,
                 ranges: int | None = None) -> DataFrame:
    """Adds, per output name, the sum from the first row up to this one.

    ``keys`` restarts the sum per key. ``order`` must be unique within a key.
    Stages the frame first (an action); the rest is lazy.
    """
    keys = keys or []
    full = [*keys, *[c for c in order if c not in keys]]
    valued = df.select("*", *[c.cast("bigint").alias(f"_v_{name}") for name, c in sums.items()])
    ranged = in_ranges(valued, full, ranges)
    here = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(f"_v_{n}").over(here).alias(f"_l_{n}") for n in sums])
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    out = _with_carry(local, keys, _sums_before(totals, keys, list(sums)))
    return out.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])


def values_before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
                  ranges: int | None = None) -> DataFrame:
    """Adds, per output name, the last non-null value of the named column in the
    rows of the same key strictly before this one.

    Stages the frame first (an action); the rest is lazy.
    """
    full = [*keys, *[c for c in order if c not in keys]]
    ranged = in_ranges(df, full, ranges)
    here = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.last(v, ignorenulls=True).over(here).alias(f"_l_{n}") for n, v in values.items()])
    lasts = (ranged.groupBy(*keys, RANGE)
             .agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_t_{n}")
                    for n, v in values.items()]))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*keys, RANGE, *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}")
                                         for n in values])
    return (_with_carry(local, keys, carry)
            .select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values]))
