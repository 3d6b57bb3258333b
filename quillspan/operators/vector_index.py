"""A vector index in cells: rows are written by the nearest of a set of centroids, and a search reads the cells it probes.

Cells are folders of the table, so that a search prunes all others before a file is opened. Centroids come from a bounded
sample, every row is indexed. A search is either approximate, by a number of cells, or exact: a cell keeps the widest angle
between its centroid and a row, which bounds the likeness of any of its rows, and cells that may hold a better row than
the k found so far are read as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .retrieval import QUERY_BLOCK, topk, vector_topk

#: Rows that centroids are learnt from, at most and for each cell; rounds; cells at most.
SAMPLE, SAMPLE_OF_CELL, ROUNDS, MOST_CELLS = 1 << 16, 64, 10, 4096
#: Rows of a file of a cell.
FILE_ROWS = 1 << 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def cells_for(rows: int) -> int:
    """About as many cells as a cell has rows."""
    return int(max(1, min(MOST_CELLS, round(rows**0.5))))


def learn(rows: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit length by k-means over directions, learnt from at most so many of the rows (id, vector): those with
    the least hashes of their ids. Starts are spread out: each is the row farthest from those before it."""
    most = min(sample, max(cells, SAMPLE_OF_CELL * cells))
    held = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    if not held.num_rows:
        return np.zeros((0, 0))
    x = unit(np.array(held.column("vector").to_pylist(), np.float64))
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(cells, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-12:
            break  # fewer directions than cells
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    centers = x[chosen]
    for _ in range(ROUNDS):
        cell = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, x)
        moved = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-12, unit(sums), centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def write_index(rows: DataFrame, path: str, cells: int | None = None) -> None:
    """Write every row (id, vector) that has a vector under path: rows by cell, and the cells with their centroid, number
    of rows and widest angle. A cell of very many rows is written by several tasks."""
    known = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    centers = learn(known, cells or cells_for(known.count()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, centers.shape[1]))
            near = x @ centers.T
            cell = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "vector", "cell", "angle"])

    placed = stored(known.mapInArrow(assign, "id long, vector array<double>, cell int, angle double"), "placed")
    sizes = stored(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")), "cells")
    spark = rows.sparkSession
    known_cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")  # MOST_CELLS at most
    sizes.join(F.broadcast(known_cells), "cell").write.mode("overwrite").parquet(f"{path}/cells")
    files = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("files")))
    dealt = placed.join(files, "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.repartition("cell", "file").select("id", "vector", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")


class Cells:
    """The cells of an index: a bounded number, on the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        held = spark.read.schema("cell int, n long, angle double, center array<double>").parquet(f"{path}/cells").orderBy("cell").toArrow()
        self.cell, self.n, self.angle = (held.column(c).to_numpy() for c in ("cell", "n", "angle"))
        self.center = np.array(held.column("center").to_pylist(), np.float64).reshape(held.num_rows, -1) if held.num_rows else np.zeros((0, 0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query of unit length and cell, the greatest cosine that a row of the cell can have."""
        apart = np.arccos(np.clip(q @ self.center.T, -1, 1))
        return np.cos(np.maximum(0, apart - self.angle))

    def nearest(self, q: np.ndarray, probe: int) -> np.ndarray:
        """A row of flags for each query: the cells whose centroids are nearest to it."""
        near, out = q @ self.center.T, np.zeros((len(q), len(self.cell)), bool)
        order = np.argsort(-near, axis=1, kind="stable")[:, :probe]
        np.put_along_axis(out, order, True, 1)
        return out


def read_cells(rows: DataFrame, probed: np.ndarray, cells: Cells, q: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, score): the k best rows of each task for each query, out of the cells that the query probes."""
    asks = {int(cells.cell[c]): np.flatnonzero(probed[:, c]) for c in np.flatnonzero(probed.any(0))}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            place = batch.column(2).to_numpy()
            x = unit(np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else None
            ids = batch.column(0).to_numpy()
            for c in np.unique(place):
                on, who = np.flatnonzero(place == c), asks.get(int(c), ())
                if not len(who):
                    continue
                s = (q[who] @ x[on].T).round(9).round(6)
                for i, row in zip(who.tolist(), s, strict=True):
                    held = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                    both, own = np.concatenate([held[0], row]), np.concatenate([held[1], ids[on]])
                    if len(both) > k:
                        least = np.partition(both, len(both) - k)[len(both) - k]
                        may = np.flatnonzero(both >= least)
                        may = may[np.lexsort((own[may], -both[may]))[:k]]
                        both, own = both[may], own[may]
                    best[i] = both, own
        for i, (s, own) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), names[i])), pa.array(own), pa.array(s)], names=["query_id", "id", "score"])

    pruned = rows.filter(F.col("cell").isin([int(c) for c in asks]))  # folders of other cells are not listed
    return pruned.select("id", "vector", "cell").mapInArrow(search, "query_id long, id long, score double")


def index_topk(queries: DataFrame, path: str, k: int, probe: int, exact: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank, cells, share): the k rows of an index nearest to each query (query_id, vector) by cosine,
    of the probe cells nearest to it; how many cells were read for the query, and their share of all rows.

    exact: cells that may hold a better row than the k-th found are read in a second pass, so the result is that of a full
    search. Scores have six places, equal ones go by id. Queries go out in blocks of those near the same cells, so that a
    block reads few cells; queries without a vector are left out.
    """
    spark = queries.sparkSession
    cells = Cells(spark, path)
    empty = "query_id long, id long, score double, rank int, cells int, share double"
    if not len(cells.cell):
        return spark.createDataFrame([], empty)
    rows = spark.read.schema("id long, vector array<double>, cell int").parquet(f"{path}/rows")

    def nearest_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, cells.center.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ cells.center.T).argmax(1), pa.int32())], names=["query_id", "vector", "near"])

    asked = queries.filter(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    asked = stored(asked.mapInArrow(nearest_cell, "query_id long, vector array<double>, near int"), "asked")
    load = [(r["near"], r["n"]) for r in asked.groupBy("near").agg(F.count(F.lit(1)).alias("n")).orderBy("near").collect()]  # a row for each cell
    parts = []
    for low, high, salts in _blocks(load, block):
        near = asked.filter(F.col("near").between(low, high))
        for salt in range(salts):
            own = near.filter(F.pmod(F.xxhash64("query_id"), F.lit(salts)) == salt).toArrow()
            names, q = own.column("query_id").to_numpy(), unit(np.array(own.column("vector").to_pylist(), np.float64).reshape(own.num_rows, -1))
            if not len(names):
                continue
            probed = cells.nearest(q, probe)
            found = stored(topk(read_cells(rows, probed, cells, q, names, k), k), "probed")
            if exact:
                kth = found.filter(F.col("rank") == k).select("query_id", "score").toArrow()
                at = {int(n): s for n, s in zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist(), strict=True)}
                least = np.array([at.get(int(n), -np.inf) for n in names])
                more = (cells.bounds(q) >= least[:, None] - 2e-6) & ~probed
                if more.any():
                    both = found.drop("rank").unionByName(read_cells(rows, more, cells, q, names, k))
                    found = stored(topk(both, k), "probed")
                probed |= more
            told = spark.createDataFrame([(int(n), int(p.sum()), float(cells.n[p].sum() / cells.n.sum())) for n, p in zip(names, probed, strict=True)], "query_id long, cells int, share double")
            parts.append(found.join(F.broadcast(told), "query_id"))  # a block of queries
    if not parts:
        return spark.createDataFrame([], empty)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "id", "score", "rank", "cells", "share")


def _blocks(load: list[tuple[int, int]], block: int) -> list[tuple[int, int, int]]:
    """(first cell, last cell, parts): runs of cells with about so many queries; a cell of more is cut into parts."""
    out: list[list[int]] = []
    held = 0
    for cell, n in load:
        if out and held + n <= block:
            out[-1][1], held = cell, held + n
        else:
            out.append([cell, cell, -(-n // block)])
            held = n
    return [(a, b, c) for a, b, c in out]


def recalls(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, cells, share): how many of a query's first k rows of the exact search were found; for each query."""
    want = exact.filter(F.col("rank") <= k).select("query_id", "id")
    got = found.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    of = found.groupBy("query_id").agg(F.max("cells").alias("cells"), F.max("share").alias("share"))
    hits = want.join(got, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return hits.join(of, "query_id", "left").select("query_id", "recall", "cells", "share")


def probe_for(queries: DataFrame, rows: DataFrame, path: str, k: int, recall: float = 0.9, margin: float = 0.03, most: int = 256) -> int:
    """The least number of cells to probe by which so much recall was reached, with a margin, on sample queries
    (query_id, vector): at most so many of them, those with the least hashes, searched exactly. Without any: all cells."""
    spark = queries.sparkSession
    cells = Cells(spark, path)
    sample = stored(queries.filter(F.col("vector").isNotNull()).orderBy(F.xxhash64("query_id"), "query_id").limit(most).select("query_id", F.col("vector").cast("array<double>").alias("vector")), "sample")
    best = vector_topk(sample, rows, k).select("query_id", "id")
    placed = spark.read.schema("id long, cell int").parquet(f"{path}/rows").join(F.broadcast(best), "id").toArrow()  # sample x k rows
    asked = sample.toArrow()
    if not len(cells.cell) or not placed.num_rows:
        return len(cells.cell)
    q = unit(np.array(asked.column("vector").to_pylist(), np.float64))
    order = np.argsort(-(q @ cells.center.T), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    row = {n: i for i, n in enumerate(asked.column("query_id").to_pylist())}
    at = np.searchsorted(cells.cell, placed.column("cell").to_numpy())
    needed = np.sort(turn[[row[n] for n in placed.column("query_id").to_pylist()], at])
    return int(needed[min(len(needed) - 1, int(np.ceil(min(1.0, recall + margin) * len(needed))) - 1)]) + 1
