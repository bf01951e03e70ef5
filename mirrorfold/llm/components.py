"""Connected components of a graph whose edges need not fit anywhere at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mirrorfold.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges(a, b)``; the root is the smallest
    node of its component. *Action.*

    Alternates large and small stars: every node's larger neighbours, then its
    smaller ones and itself, are linked to the smallest neighbour, until every
    edge leads from a node with no other edge to its root. Minima combine before
    the shuffle and the joins are plain equi-joins, so a hub is split by adaptive
    execution. Each round is written to the checkpoint folder; an edge goes both
    ways in one pass over it, so a round has few tasks. Loops, repeated and null
    edges are ignored.
    """
    current = cut_lineage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(current):
        both = _each(current, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        stars = stars.join(least, "u")
        current = cut_lineage(_each(stars, ("v", "m"), ("u", "m")).filter("u <> v").distinct())
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select("v", "v")).distinct()


def _each(df: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """A row ``u, v`` for each of the pairs of columns."""
    return df.select(F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ends])))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of ``edges(u, v)`` has one edge and is no v. *Action.*"""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter("up > 1 or up = 1 and down = 1").agg(F.count("*")).head()[0]
