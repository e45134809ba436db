"""Files that arrive in a folder, read as they come.

Rows are those of ``sources.pdf.documents``: the same parser runs in each
micro-batch, and a checkpoint remembers which files were taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagelume.sources import pdf

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Documents of the PDF files below ``root``, a stream."""
    files = (
        spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_per_batch).load(root)
    )
    return pdf.parsed(files.select("path", "content"))


def running_population(docs: DataFrame) -> DataFrame:
    """Files, unopenable files and pages so far; state is one row."""
    rows = pdf.population(docs)
    return rows.groupBy().agg(F.count("*").alias("files"), F.count_if("unopenable").alias("unopenable"), F.sum(F.greatest(F.col("pages"), F.lit(0))).cast("bigint").alias("pages"))


def to_table(docs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each batch to Parquet files, each file's row once."""
    return docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
