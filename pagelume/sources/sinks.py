"""Row files in a stated order, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in the order of ``order`` over all files by name; fields without a value are left out.

    Sorting cuts the rows into ranges, one file each, so the order costs one
    shuffle and no single task.
    """
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of ``write_lines``; a broken line fails the read, an unknown field is ignored."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cell(c: Column, kind: str, places: int = 6) -> Column:
    """A value of a tab-separated report: no tabs or line ends within, '-' for null and NaN."""
    if kind in ("double", "float"):
        c = F.when(~F.isnan(c), F.regexp_replace(F.format_string(f"%.{places}f", c.cast("double")), r"\.?0+$", ""))
    return F.coalesce(F.regexp_replace(c.cast("string"), "[\t\r\n]", " "), F.lit("-"))


def write_table(df: DataFrame, path: str, *order: str) -> None:
    """Tab-separated text with a heading in each file."""
    rows = df.orderBy(*order) if order else df
    rows.select(*[cell(F.col(f"`{c}`"), kind).alias(c) for c, kind in df.dtypes]).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def summary_line(counters: DataFrame, reasons: DataFrame) -> DataFrame:
    """One JSON text of outcome counters with their reasons as a map."""
    listed = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "pages")))).alias("reasons"))
    return counters.crossJoin(F.broadcast(listed)).select(F.to_json(F.struct("*")).alias("value"))
