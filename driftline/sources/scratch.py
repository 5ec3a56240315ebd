"""Space that driver and executors share, for tables that cut a lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/driftline/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Queries that are run in here leave no shuffle files; the session's own setting is put back."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write a Parquet table to the shared folder and read it again.

    What is written is read from then on, so the shuffles that made it are of no more use and go at once.

    The default codec works on the heap; the usual one keeps buffers outside it, which add up where tables are many.
    Tables of hashes, which do not compress, may be written ``uncompressed``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._driftline_path = path
    return back


def together(parts: list[DataFrame]) -> DataFrame:
    """Tables of written() with one schema as one table, read by one scan; drop_written() removes them all."""
    back = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(t._driftline_path for t in parts))
    back._driftline_parts = parts
    return back


def drop_written(df: DataFrame) -> None:
    """Remove a table of written() that nothing reads any more."""
    for part in getattr(df, "_driftline_parts", [df]):
        path = getattr(part, "_driftline_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
