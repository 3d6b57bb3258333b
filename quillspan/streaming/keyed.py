"""Streams of keyed events: a cache whose entries run out, and the latest stage of each key as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import latest


def once(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The stream with each key once. A key's state is dropped when the watermark has passed it by delay; repeats within
    the delay never come through, rows older than the watermark neither."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def cache_hits(requests: DataFrame, entries: DataFrame, keys: list[str], ttl: str, delay: str = "10 minutes") -> DataFrame:
    """(request, entry): each request with every entry of its keys that was put at most ttl before it.

    Both are streams with an event time, at, and an id; repeated rows (of one id) count once. The time range bounds the
    state: an entry is held until no request can reach it any more.
    """
    ask = once(requests, ["id"], "at", delay)
    put = once(entries, ["id"], "at", delay)
    r = ask.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.struct("id", "at").alias("request"), F.col("at").alias("r_at"))
    e = put.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.struct("id", "at").alias("entry"), F.col("at").alias("e_at"))
    on = (F.col("e_at") <= F.col("r_at")) & (F.col("e_at") >= F.col("r_at") - F.expr(f"INTERVAL {ttl}"))
    for k in keys:
        on = on & (F.col(f"r_{k}") == F.col(f"e_{k}"))
    return r.join(e, on).select("request", "entry")


class StageTable:
    """The latest event of each key, as a log of batches under path: a batch that is written again takes its own place."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, schema: str) -> None:
        self.spark, self.path, self.keys, self.order = spark, path, keys, order
        self.schema = f"{schema}, batch long"

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: what the batch leaves of each key. Running it twice leaves the same."""
        latest(batch, self.keys, self.order).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/{number:012d}")

    def read(self) -> DataFrame:
        """The latest event of each key over all batches, equal times by the rest of the row."""
        log = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
        return latest(log.drop("batch"), self.keys, self.order)

    def compact(self, until: int) -> None:
        """Batches up to a number become one, written under the last one's number before the others go."""
        folders = [f"{self.path}/{n:012d}" for n in self.numbers() if n <= until]
        if len(folders) < 2:
            return
        log = self.spark.read.schema(self.schema).parquet(*folders)
        whole = f"{self.path}/_compact-{until:012d}"  # readers pass over it
        latest(log.drop("batch"), self.keys, self.order).withColumn("batch", F.lit(until)).write.mode("overwrite").parquet(whole)
        files, path = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path
        target = path(f"{self.path}/{until:012d}")
        # Until the older folders go, a reader sees rows twice, never none: the latest event stays the latest.
        for status in files.listStatus(path(whole)):
            if status.getPath().getName().startswith("part-"):
                files.rename(status.getPath(), path(target, f"whole-{status.getPath().getName()}"))
        for folder in folders[:-1]:
            files.delete(path(folder), True)
        files.delete(path(whole), True)

    def numbers(self) -> list[int]:
        found = self._files().listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def _files(self):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())
