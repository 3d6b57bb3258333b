"""User memories: upserts, profiles and the latest state of keyed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SINGLE = ("budget", "tone")


def upserted(log: DataFrame) -> DataFrame:
    """The memories that hold after a log (user_id, memory_type, content, importance, seq) has been applied in order.

    A content of a user and type is one memory, with its greatest importance; of single-valued types only the content
    named last is active.
    """
    once = log.groupBy("user_id", "memory_type", F.lower("content").alias("content")).agg(F.max("importance").alias("importance"), F.max("seq").alias("seq"))
    last = F.row_number().over(Window.partitionBy("user_id", "memory_type").orderBy(F.desc("seq"))) == 1
    return once.withColumn("is_active", ~F.col("memory_type").isin(*SINGLE) | last)


def profiles(memories: DataFrame) -> DataFrame:
    """One row for each user: the most important budget and tone, interests and what to avoid as sorted lists."""
    active = memories.filter("is_active")
    best = lambda t: F.max(F.when(F.col("memory_type") == t, F.struct("importance", "seq", "content")))["content"].alias(t)
    each = lambda *t: F.array_join(F.sort_array(F.collect_set(F.when(F.col("memory_type").isin(*t), F.col("content")))), ",")
    return active.groupBy("user_id").agg(best("budget"), best("tone"), each("interest").alias("interests"), each("avoid", "constraint").alias("avoid"))


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
