"""Object graphs of documents: (doc, src, dst) references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelume.plans.shared import written


def dangling(refs: DataFrame, defined: DataFrame) -> DataFrame:
    """Distinct references to objects (doc, obj) that aren't defined."""
    known = defined.select("doc", F.col("obj").alias("dst"))
    return refs.join(known, ["doc", "dst"], "left_anti").select("doc", "src", "dst").distinct()


def reachable(refs: DataFrame, roots: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """(doc, root, obj) of every object that a root reaches, itself included.

    The frontier grows one step per round until it is empty.  A barrier (doc,
    obj) is reached but not passed.
    """
    links = refs.select("doc", F.col("src").alias("obj"), "dst").distinct()
    if barriers is not None:
        links = links.join(barriers.select("doc", "obj"), ["doc", "obj"], "left_anti")
    front = written(roots.select("doc", "root", F.col("root").alias("obj")).distinct(), "reach")
    seen = front
    while front.limit(1).count():
        step = front.join(links, ["doc", "obj"]).select("doc", "root", F.col("dst").alias("obj")).distinct()
        front = written(step.join(seen, ["doc", "root", "obj"], "left_anti"), "reach")
        seen = written(seen.union(front), "reached")
    return seen


def page_counts(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, obj, pages): how many roots reach each object."""
    return reachable(refs, roots).groupBy("doc", "obj").agg(F.countDistinct("root").alias("pages"))


def partition(refs: DataFrame, pages: DataFrame, document: DataFrame) -> DataFrame:
    """(doc, obj, part, owner) of each object in the order in which a linearized file holds them.

    ``pages`` is (doc, page, root), ``document`` (doc, obj) what opens the file.
    The first match counts: 4 what the document needs, 6 the first page, 7 an
    object of one other page (owner), 8 one that several share, 9 the rest.
    """
    reach = reachable(refs, pages.select("doc", "root")).join(pages, ["doc", "root"])
    opens = reachable(refs, document.select("doc", F.col("obj").alias("root")), pages.select("doc", F.col("root").alias("obj"))).select("doc", "obj").distinct().withColumn("opens", F.lit(True))
    per = reach.groupBy("doc", "obj").agg(F.min("page").alias("first"), F.countDistinct("page").alias("n"))
    every = refs.select("doc", F.col("src").alias("obj")).union(refs.select("doc", F.col("dst").alias("obj"))).union(pages.select("doc", "root")).union(document.select("doc", "obj")).distinct()
    roots = pages.select("doc", F.col("root").alias("obj"), F.lit(True).alias("is_page"))
    joined = every.join(per, ["doc", "obj"], "left").join(opens, ["doc", "obj"], "left").join(roots, ["doc", "obj"], "left")
    lowest = F.min("first").over(Window.partitionBy("doc"))
    part = (
        F.when(F.col("opens") & F.col("is_page").isNull(), 4)
        .when(F.col("first") == F.col("lowest"), 6)
        .when(F.col("n") == 1, 7)
        .when(F.col("n") > 1, 8)
        .otherwise(9)
    )
    return joined.withColumn("lowest", lowest).select("doc", "obj", part.alias("part"), F.when(part.isin(6, 7), F.col("first")).alias("owner"))
