"""Row numbers within few or hot groups, without one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def in_slices(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df as a table with slice, the range of (by, order) that a row is in: slices of a group follow one another."""
    return stored(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("slice", F.spark_partition_id()), "slices")


def numbered(df: DataFrame, by: list[str], order: list[Column], to: str = "rank", size: str | None = None) -> DataFrame:
    """df with each row's number from 1 in its group; size names a column for the group's rows, if wanted.

    Rows are numbered in slices of the group's order, and a slice starts where the ones before it end. order must be
    total within a group.
    """
    sliced = in_slices(df, by, order)
    counts = sliced.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(*by)).alias("__size"))
    at = starts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("slice").alias("__slice"), "__start", "__size")
    same = F.col("slice") == F.col("__slice")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = F.row_number().over(Window.partitionBy(*by, "slice").orderBy(*order))
    rows = sliced.withColumn("__r", own).join(at, same)
    extra = [F.col("__size").alias(size)] if size else []
    return rows.select(*df.columns, (F.col("__r") + F.col("__start")).alias(to), *extra)


def carried(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df with previous, the value of the row before in the group, and known, the last one before it that isn't null.

    order: columns, ascending. What a slice ends with is carried on to the next ones.
    """
    sliced = in_slices(df, by, [F.col(c) for c in order])
    last = sliced.groupBy(*by, "slice").agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("end"),
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("seen"),
    )
    before = Window.partitionBy(*by).orderBy("slice")
    carry = last.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("slice").alias("__slice"), F.lag(F.col(f"end.{value}")).over(before).alias("__previous"), F.last("seen", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("__known"))
    same = F.col("slice") == F.col("__slice")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = Window.partitionBy(*by, "slice").orderBy(*order)
    known = F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = sliced.withColumn("__first", F.row_number().over(own) == 1).withColumn("previous", F.lag(value).over(own)).withColumn("known", known).join(carry, same)
    return rows.select(*df.columns, F.when(F.col("__first"), F.col("__previous")).otherwise(F.col("previous")).alias("previous"), F.coalesce("known", "__known").alias("known"))
