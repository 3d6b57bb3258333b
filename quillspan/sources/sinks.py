"""Sinks: idempotent appends, staged writes, reports and stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose keys the table at path lacks, each once; returns those. Running it again appends nothing."""
    spark = rows.sparkSession
    own = rows.dropDuplicates(keys)
    try:
        have = spark.read.parquet(path).select(*keys)
        own = own.join(have, keys, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    own = stored(own, "new")  # a cached table would be computed anew after the append, and be empty
    own.write.mode("append").parquet(path)
    return own


def write_document_chunks(documents: DataFrame, chunks: DataFrame, path: str, key: str = "document_id") -> None:
    """Chunks first, then their documents: readers go through documents, so a failed write shows nothing half done."""
    chunks.write.mode("append").partitionBy("city").parquet(f"{path}/chunks")
    documents.write.mode("append").parquet(f"{path}/documents")


def readable_chunks(chunks: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks of documents that were written to their end."""
    return chunks.join(documents.select(key).distinct(), key, "left_semi")


def merged_status(queue: DataFrame, updates: DataFrame, key: str = "url_id") -> DataFrame:
    """queue with status and error_message of its last update (key, status, error_message, seq), where there is one."""
    last = updates.groupBy(key).agg(F.max(F.struct("seq", "status", "error_message")).alias("u"))
    keep = [c for c in queue.columns if c not in ("status", "error_message")]
    own = F.col("error_message") if "error_message" in queue.columns else F.lit(None).cast("string")
    told = F.col("u").isNotNull()
    return queue.join(last, key, "left").select(*keep, F.when(told, F.col("u.status")).otherwise(F.col("status")).alias("status"), F.when(told, F.col("u.error_message")).otherwise(own).alias("error_message"))


def csv_report(df: DataFrame, path: str) -> None:
    """A CSV report, arrays and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]).write.mode("overwrite").option("header", True).csv(path)


def stage_event(kind: Column, **fields: Column) -> Column:
    """One line of the stage stream: JSON with its kind first."""
    return F.to_json(F.struct(kind.alias("type"), *[v.alias(k) for k, v in fields.items()]))


def ndjson(events: DataFrame, path: str) -> None:
    """Lines of JSON (column value), one for each event."""
    events.select("value").write.mode("append").text(path)


def markdown_files(df: DataFrame, key: str, text: str, path: str, folders: int = 256) -> None:
    """Markdown of documents as lines of JSON (key, markdown), dealt to a fixed number of folders by the key's hash: one
    document's is found by its folder, and there are never as many files as documents."""
    rows = df.select(F.col(key), F.col(text).alias("markdown"), F.pmod(F.xxhash64(key), F.lit(folders)).alias("folder"))
    rows.repartition("folder").write.mode("overwrite").partitionBy("folder").json(path)
