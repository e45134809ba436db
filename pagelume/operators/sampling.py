"""Sampling frames and content manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelume.plans.shared import written


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by a hash of seed and key: the same draw however the table is cut up."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(h, key).limit(n)


def frame_guard(df: DataFrame, key: str, share: float = 0.9, fail: bool = True) -> DataFrame:
    """(n, ids, sound): rows and distinct keys; raises on reading if keys repeat too often and ``fail`` is set."""
    counts = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("ids"))
    sound = F.col("ids") >= F.lit(share) * F.col("n")
    guarded = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("too many repeated ids in the frame"))) if fail else sound
    return counts.select("n", "ids", guarded.alias("sound"))


def strip_before_header(content, header: str = "%PDF-"):
    """Bytes from the header on; all of them if there is none."""
    at = F.locate(header, F.decode(content, "ISO-8859-1"))
    return F.when(at > 1, F.substring(content, at, F.octet_length(content))).otherwise(content)


def manifest(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, source, bytes, sha256) of distinct contents in order of ``key``, while their sizes add up to at most ``budget``.

    Sizes and digests are taken in one pass; the running sum is a sum per
    range of keys plus a sum within it, so no task sees all rows.
    """
    facts = rows.select(F.col(key), "source", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    copy = F.row_number().over(Window.partitionBy("sha256").orderBy(key))
    first = facts.withColumn("copy", copy).filter("copy = 1").drop("copy")
    cut = written(first.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "manifest")
    sums = cut.groupBy("part").agg(F.sum("bytes").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(sums.select("part", before.alias("base")))
    inside = F.sum("bytes").over(Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("inside", inside).join(base, "part").filter(F.col("inside") + F.col("base") <= budget).select(key, "source", "bytes", "sha256")
