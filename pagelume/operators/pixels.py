"""Pixels of rendered pages against the rasters on them, as rows (page, x, y, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame(rotate: Column, width: Column, height: Column, scale: Column) -> Column:
    """Matrix from page points to pixels of a rendering that is turned by ``rotate`` and has its origin at the top."""
    w, h, zero = width * scale, height * scale, F.lit(0.0)
    turned = F.pmod(rotate, F.lit(360))
    return (
        F.when(turned == 90, F.array(zero, scale, scale, zero, zero, zero))
        .when(turned == 180, F.array(-scale, zero, zero, scale, w, zero))
        .when(turned == 270, F.array(zero, -scale, -scale, zero, h, w))
        .otherwise(F.array(scale, zero, zero, -scale, zero, h))
    )


def pixel_box(box: Column) -> Column:
    """Pixels that a box touches, the end exclusive."""
    return F.array(F.floor(box[0]), F.floor(box[1]), F.ceil(box[2]), F.ceil(box[3]))


def inside(x: Column, y: Column, box: Column, guard: Column | int = 0) -> Column:
    """A pixel lies within a box that is wider by ``guard`` on all sides."""
    return (x >= box[0] - guard) & (x < box[2] + guard) & (y >= box[1] - guard) & (y < box[3] + guard)


def ink_outside(pixels: DataFrame, rasters: DataFrame, guards: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(page, ink, outside_0, ...): inked pixels of each page, and those outside its raster's box by each guard.

    ``pixels`` has one row per pixel (page, x, y, ink), ``rasters`` one per page
    (page, box); a page without a raster has all of its ink outside.
    """
    joined = pixels.filter("ink").join(rasters.select("page", "box"), "page", "left")
    out = [F.count_if(~F.coalesce(inside(F.col("x"), F.col("y"), F.col("box"), g), F.lit(False))).alias(f"outside_{g}") for g in guards]
    return joined.groupBy("page").agg(F.count("*").alias("ink"), *out)


def wash_classes(pixels: DataFrame) -> DataFrame:
    """(page, deep, edge, clear, outside) pixel counts of a background wash under a page's ink.

    ``pixels`` is (page, x, y, washed, ink): a washed pixel is *deep* if it and
    its eight neighbours are free of ink, *edge* if a neighbour is inked,
    *clear* if it isn't washed within the page's washed box, and *outside* if
    it lies beyond that box.
    """
    steps = F.explode(F.expr("flatten(transform(array(-1, 0, 1), dx -> transform(array(-1, 0, 1), dy -> named_struct('dx', dx, 'dy', dy))))")).alias("s")
    near = pixels.filter("ink").select("page", "x", "y", steps).select("page", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).distinct().withColumn("near", F.lit(True))
    box = pixels.filter("washed").groupBy("page").agg(F.array(F.min("x"), F.min("y"), F.max("x") + 1, F.max("y") + 1).alias("box"))
    rows = pixels.join(near, ["page", "x", "y"], "left").join(box, "page", "left").withColumns({"near": F.coalesce("near", F.lit(False)), "within": F.coalesce(inside(F.col("x"), F.col("y"), F.col("box")), F.lit(False))})
    return rows.groupBy("page").agg(
        F.count_if(F.expr("washed and not near")).alias("deep"), F.count_if(F.expr("washed and near")).alias("edge"), F.count_if(F.expr("not washed and within")).alias("clear"), F.count_if(F.expr("not within")).alias("outside")
    )


def extents(table: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, least and number of bits for the range of each column), as hint tables store them."""
    aggs = []
    for c in columns:
        spread = F.max(c) - F.min(c)
        aggs += [F.min(c).alias(f"{c}_least"), F.when(spread > 0, F.length(F.bin(spread))).otherwise(0).cast("bigint").alias(f"{c}_bits")]
    return table.groupBy(by).agg(*aggs)
