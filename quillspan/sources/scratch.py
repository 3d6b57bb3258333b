"""Intermediate tables in the folder that the session's spark.checkpoint.dir names, which all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this thread of the driver has handed out and not yet removed.
_mine = threading.local()


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local master may do without: its only machine has a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"{tempfile.gettempdir()}/quillspan-{spark.sparkContext.applicationId}"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{folder(spark)}/quillspan-{label}-{uuid.uuid4().hex}"
    _mine.paths = [*getattr(_mine, "paths", []), path]
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: its lineage is cut."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove this thread's tables, once the results that read them are written."""
    for path in getattr(_mine, "paths", []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _mine.paths = []
