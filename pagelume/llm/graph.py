"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelume.llm.storage import dropped, written


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with m, the least neighbour of a: counted by partial aggregation, so that a hub costs no task more than others."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _with_least(down)
    moved = least.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the least node of its component.

    The rounds grow with the logarithm of the longest path.  Edges stay
    distributed; each round's table replaces the one before.  The edges of a
    hub are joined with one row, a join that the engine splits where it is
    skewed.  Loops and
    repeated edges don't matter; a table without edges has no nodes.
    """
    now = written(edges.select("a", "b").filter("a != b").distinct(), "stars")
    mark = _mark(now)
    while mark[0]:
        after = written(_small_star(_large_star(now)), "stars")
        seen = _mark(after)
        dropped(now)
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
