"""Exact order statistics without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelume.plans.shared import written


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank`` (0-based) in the total order of ``order`` and ``total``, the number of rows.

    Rows are range-partitioned once; each partition is numbered by itself, and
    only one count per partition is summed up in order.
    """
    cut = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"))
    ordered = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return cut.withColumn("inside", inside).join(F.broadcast(base), "part").withColumn("rank", F.col("inside") + F.col("base")).drop("part", "inside", "base")


def floor_percentiles(counts: DataFrame, column: str, weights: dict[str, str], shares: dict[str, float]) -> DataFrame:
    """(section, name, value): for each section of ``weights`` and share p the value of rank floor(p (n - 1)).

    ``counts`` has rows of a value and how often it occurs, in one column for
    each section; n is that column's sum.  Nulls are left out; a section
    without values has no rows.  Only rows of counts are sorted.
    """
    seen = counts.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"), *[F.col(w).alias(f"n{i}") for i, w in enumerate(weights.values())])
    cut = written(seen.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    before, all_ = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = range(len(weights))
    sizes = cut.groupBy("part").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in numbers])
    base = sizes.select("part", *[F.coalesce(F.sum(f"n{i}").over(before), F.lit(0)).alias(f"base{i}") for i in numbers], *[F.sum(f"n{i}").over(all_).alias(f"total{i}") for i in numbers])
    upto = cut.withColumns({f"end{i}": F.sum(f"n{i}").over(inside) for i in numbers}).join(F.broadcast(base), "part")
    picks = []
    for i, section in enumerate(weights):
        end = F.col(f"base{i}") + F.col(f"end{i}")
        for name, p in shares.items():
            rank = F.floor(F.lit(p) * (F.col(f"total{i}") - 1))
            picks.append(F.when((rank >= end - F.col(f"n{i}")) & (rank < end), F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"))))
    names = F.filter(F.array(*picks), lambda x: x.isNotNull())
    return upto.withColumn("names", names).filter(F.size("names") > 0).select(F.explode("names").alias("k"), F.col("v").alias("value")).select("k.*", "value")
