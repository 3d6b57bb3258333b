"""Closures and breadth-first search over tables of edges, a join for each level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def reachable(edges: DataFrame, roots: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(root, node, level): what each root (column root) reaches over edges (src, dst), itself at level 0; cycles end.

    A level is a join of the frontier with the edges and an anti-join with what is known; both are written tables.
    """
    frontier = stored(roots.select("root", F.col("root").alias("node")).distinct().withColumn("level", F.lit(0)), "frontier")
    known, level = frontier, 0
    while most_levels is None or level < most_levels:
        level += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(known.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known
