"""Shared intermediate tables and row identities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts on its way to Python, but for a row that alone has more.
BATCH_BYTES = 4 << 20
_local: dict[str, str] = {}
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may lack the setting; it then gets a temporary folder.
    """
    set_to = spark.conf.get(_CONF, None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{_CONF} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="pagelume-")
    return "file://" + _local[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, free of its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by_batches(df: DataFrame, name: str) -> DataFrame:
    """``written``, for whole texts that go through Python: in Arrow batches of about BATCH_BYTES.

    By rows alone a batch has 10,000 texts of any length, which the JVM and the
    worker each hold several times.  The session's setting is put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(_BATCH, None)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return written(df, name)
    finally:
        if before is None:
            conf.unset(_BATCH)
        else:
            conf.set(_BATCH, before)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        made = next((t for t in _tables if f"/{t.rsplit('/', 1)[1]}/" in file), None)
        if made:
            _tables.remove(made)
            _delete(df.sparkSession, made)


def so_far() -> int:
    """A mark for ``cleared``."""
    return len(_tables)


def cleared(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables made since ``mark`` but for those that ``keep`` reads; their readers must have run."""
    needed = " ".join(f for df in keep for f in df.inputFiles())
    for path in _tables[mark:]:
        if f"/{path.rsplit('/', 1)[1]}/" not in needed:
            _tables.remove(path)
            _delete(spark, path)


def numbered(df: DataFrame, name: str = "rows") -> DataFrame:
    """(uid, r): each row of ``df`` as one struct with a number of its own, written once.

    Numbers follow partitions, which depend on executors and settings; only a
    written table gives every later reader the same number for the same row.
    """
    return written(df.select(F.monotonically_increasing_id().alias("uid"), whole_row(df).alias("r")), name)


def row_id() -> Column:
    """A number for each row, for a table that is written at once and read for this number alone from then on."""
    return F.monotonically_increasing_id()


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, as Spark SQL."""
    return df.schema[column].dataType.simpleString()


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no column of the input can clash with one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])
