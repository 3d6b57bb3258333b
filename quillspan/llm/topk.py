"""Exact top-k search by inner product: the three-phase uniform threshold algorithm (Cao and Wang, 2004).

A vector's components are dealt into lists; its score is the sum of its local scores in these. Tasks hold some rows and
all their lists.

1. Each task gathers the best local scores of every list. The k-th best total of what was gathered anywhere is a safe
   cutoff: k rows reach it.
2. The cutoffs go to all tasks. A row that reaches cutoff / lists in no list has a total under the cutoff, so the rows
   that reach it in some list are sufficient. What a row lacks is less than that threshold, which bounds its total.
3. Only rows whose bound reaches the cutoff get their remaining local scores and an exact total. Those that reach the
   cutoff, and are among the task's best k, are shuffled: few more than k for each query, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import integer_vectors, products, unpacked

SCALE, TOP, EVERY = 64, 20, 20
#: Lists that the components are dealt into; queries that one search sends to the tasks; rows and queries of a tile.
LISTS, QUERY_BLOCK, TILE_ROWS, TILE_QUERIES = 4, 1 << 14, 2048, 256
_NONE = np.iinfo(np.int64).min


class Queries:
    """A block of queries, as it is sent to tasks: row numbers, ids and vectors; cutoffs in the second pass."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, packed: list[bytes], lists: int, cutoff: np.ndarray | None = None) -> None:
        order = np.argsort(rows, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        self.packed = [packed[i] for i in order]
        self.width, self.lists = max((len(p) // 4 for p in packed), default=0), max(1, lists)
        self.cutoff = np.full(len(rows), _NONE) if cutoff is None else cutoff

    def tiles(self, rows: np.ndarray, packed: list[bytes]) -> Iterator[tuple[slice, slice, list[np.ndarray], np.ndarray]]:
        """(queries, rows, local scores by list, own): own marks a query's own row among them."""
        q = unpacked(self.packed, self.width)
        parts = np.array_split(np.arange(self.width), self.lists)
        for r in range(0, len(rows), TILE_ROWS):
            at = slice(r, min(len(rows), r + TILE_ROWS))
            x = unpacked(packed[at], self.width)
            place = np.searchsorted(self.rows, rows[at])
            asks = np.flatnonzero(self.rows[np.minimum(place, len(self.rows) - 1)] == rows[at])
            for s in range(0, len(q), TILE_QUERIES):
                of = slice(s, min(len(q), s + TILE_QUERIES))
                own = np.zeros((of.stop - s, at.stop - r), bool)
                here = asks[(place[asks] >= s) & (place[asks] < of.stop)]
                own[place[here] - s, here] = True
                yield of, at, [products(q[of][:, p], x[:, p]) for p in parts], own


def best_totals(local: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """For each query the k best totals, in no order, among the rows that are in the best k of a list; fewer are filled up."""
    total, gathered = sum(local), np.zeros(own.shape, bool)
    for s in local:
        s = np.where(own, _NONE, s)
        k_here = min(k, s.shape[1])
        np.put_along_axis(gathered, np.argpartition(s, s.shape[1] - k_here, axis=1)[:, s.shape[1] - k_here :], True, 1)
    t = np.where(gathered & ~own, total, _NONE)
    return np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k :] if t.shape[1] > k else t


def sufficient(local: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, total) of the rows that reach a cutoff now that is at least the broadcast one."""
    m, known = len(local), (cutoff > _NONE)[:, None]
    bound, seen = np.zeros(own.shape, np.int64), ~own & ~known
    least = np.where(known, cutoff[:, None], 0)
    for s in local:
        reaches = ~known | (m * s >= least)
        seen |= reaches & ~own
        bound += np.where(reaches, m * s, least - 1)
    may = seen & (~known | (bound >= m * np.where(known, now[:, None], 0)))
    a, b = np.nonzero(may)
    total = sum(s[a, b] for s in local)
    on = total >= now[a]
    return a[on], b[on], total[on]


def best_rows(found: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's best k of (query, total, id, row): ties by id, null ids last, then by row number."""
    order = np.lexsort((found[:, 3], found[:, 2], null, -found[:, 1], found[:, 0]))
    q = found[order, 0]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def top_products(rows: DataFrame, queries: DataFrame, k: int = TOP, lists: int = LISTS, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best rows by inner product, all if there are fewer.

    rows and queries: row (a number of its own for each row), vec_id, key (as integer_vectors packs it); a query meets all
    rows but that of its own number. Ties go to the smaller vec_id, null ids last. A vector of fewer components has zeros
    for the rest. Queries go out in blocks of about so many; a block is two passes over the rows.
    """
    asked = queries.count()
    blocks, parts = max(1, -(-asked // block)), []
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    for b in range(blocks):
        held = dealt.filter(F.col("block") == b).select("row", "vec_id", "key").toArrow()  # one block at a time, of a fixed size
        names = held.column("row").to_numpy()
        if not len(names):
            continue
        ids, packed = held.column("vec_id").to_numpy(), held.column("key").to_pylist()
        first = Queries(names, ids, packed, lists)

        def gather(batches: Iterator[pa.RecordBatch], block: Queries = first) -> Iterator[pa.RecordBatch]:
            best = np.full((len(block.rows), k), _NONE)
            for batch in batches:
                for of, _, local, own in block.tiles(batch.column(0).to_numpy(), batch.column(2).to_pylist()):
                    both = np.concatenate([best[of], best_totals(local, own, k)], axis=1)
                    best[of] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            a, c = np.nonzero(best > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(block.rows[a]), pa.array(best[a, c])], names=["row", "score"])

        lists_of = rows.select("row", "vec_id", "key").mapInArrow(gather, "row long, score long")
        ranked = lists_of.withColumn("r", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).filter(F.col("r") <= k)
        cut = ranked.groupBy("row").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).toArrow()
        cutoff = np.full(len(names), _NONE)
        cutoff[np.searchsorted(first.rows, cut.column("row").to_numpy())] = cut.column("cutoff").to_numpy()
        second = Queries(names, ids, packed, lists, cutoff)

        def collect(batches: Iterator[pa.RecordBatch], block: Queries = second) -> Iterator[pa.RecordBatch]:
            found, null, now = np.zeros((0, 4), np.int64), np.zeros(0, bool), block.cutoff.copy()

            def shortened() -> None:
                nonlocal found, null
                best = best_rows(found, null, k)
                found, null = found[best], null[best]
                if not len(found):
                    return
                edge = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
                size = np.diff(np.append(edge, len(found)))
                full = edge[size == k]
                now[found[full, 0]] = np.maximum(now[found[full, 0]], found[full + k - 1, 1])

            for batch in batches:
                numbers, id = batch.column(0).to_numpy(), batch.column(1)
                void, id = id.is_null().to_numpy(zero_copy_only=False), id.fill_null(0).to_numpy()
                more, gone, size = [found], [null], len(found)
                for of, at, local, own in block.tiles(numbers, batch.column(2).to_pylist()):
                    a, c, total = sufficient(local, own, block.cutoff[of], now[of])
                    c = c + at.start
                    more.append(np.column_stack([a + of.start, total, id[c], numbers[c]]))
                    gone.append(void[c])
                    size += len(a)
                    if size > 2 * k * len(block.rows) + (1 << 18):
                        found, null = np.concatenate(more), np.concatenate(gone)
                        shortened()
                        more, gone, size = [found], [null], len(found)
                found, null = np.concatenate(more), np.concatenate(gone)
                shortened()
            out = [pa.array(block.rows[found[:, 0]]), pa.array(block.ids[found[:, 0]]), pa.array(found[:, 2], mask=null), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(out, names=["row", "query_id", "vec_id", "score"])

        found = rows.select("row", "vec_id", "key").mapInArrow(collect, "row long, query_id long, vec_id long, score long")
        parts.append(materialize(found, "found") if blocks > 1 else found)
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best rows for each row whose vec_id is divisible by twenty.

    Vectors that are null or hold a null or non-finite component take no part. Repeated rows are rows of their own, so
    they find one another; a null id asks nothing. An empty table gives an empty one. Other columns don't matter.
    """
    whole = integer_vectors(table(spark, sf_dir, "embeddings"), SCALE).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(whole, "numbered")
    return top_products(rows, rows.filter(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q, row_number() OVER () AS row FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.row, a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q, true), lambda p: p[1] * p[2])), 0)::BIGINT AS score
 FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s) WHERE rank <= {TOP}
"""
