"""Structured Streaming: the URL queue, conversation state, windowed telemetry and latest stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import new_path


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a file stream; its schema is the table's."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parque[t]")


def drained(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, to its end, and read the table it wrote."""
    spark = df.sparkSession
    path = new_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("append").parquet(path)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__batch", T.LongType())])).parquet(path)


def each_batch(df: DataFrame, path: str, work: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what there is, to its end: each micro-batch and its number go to work; progress is kept beside path."""
    df.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(work).start().awaitTermination()


def processed_queue(queue: DataFrame) -> DataFrame:
    """Each open URL becomes completed, or failed where its page is empty."""
    done = F.when(F.length("html") > 0, "completed").otherwise("failed")
    return queue.select("page_id", "url", done.alias("status"))


def conversation_states(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, last_turn, last_role, chars): folded turn by turn; an empty turn leaves the state as it is."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, role, chars = state.get if state.exists else (0, -1, "", 0)
        for f in frames:
            for turn, who, text in sorted(zip(f["turn"], f["role"], f["text"].fillna(""), strict=True)):
                if not text.strip():
                    continue
                n, chars = n + 1, chars + len(text)
                if turn >= last:
                    last, role = int(turn), who
        state.update((n, last, role, chars))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "last_turn": [last], "last_role": [role], "chars": [chars]})

    return turns.groupBy("conv_id").applyInPandasWithState(
        fold, "conv_id long, n_turns long, last_turn long, last_role string, chars long", "n long, last long, role string, chars long", "update", GroupStateTimeout.NoTimeout
    )


def windowed_telemetry(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by stage in tumbling windows of event time; a platform feature beside the queue and the state."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = at.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "stage", "n", "total")
