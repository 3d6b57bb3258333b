"""Centroid clustering in integers, by weighted deduplication.

Identical quantised vectors become one with a multiplicity, Lloyd's rounds run over the distinct ones with weighted
integer sums, and the assignments are joined back to the ids. What a round sends is a centroid's sums from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import integer_vectors, products, unpacked

SCALE, LENGTH, CENTROIDS, ROUNDS = 1024, 64, 8, 10
#: Vectors of more than one row in so many are joined back by broadcast: there are fewer of them than this.
HEAVY = 10_000


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid and the squared distance; ties go to the smaller number."""
    if np.abs(x).max(initial=0) < 1 << 20 and np.abs(centroids).max(initial=0) < 1 << 20:
        d = (x * x).sum(1)[:, None] - 2 * products(x, centroids) + (centroids * centroids).sum(1)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    which = d.argmin(1)
    return which, d[np.arange(len(x)), which]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(key, weight): the distinct vectors of (vec_id, key) and how many rows have each, as a table."""
    return materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("weight")), "vectors")


def first_centroids(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """The vectors of the n rows whose `seed:vec_id` has the least SHA-256, in that order; null ids come last, ties go by the
    vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select(digest.alias("h"), "key").orderBy(F.asc_nulls_last("h"), "key").limit(n).collect()
    return unpacked([r["key"] for r in chosen], len(chosen[0]["key"]) // 4 if chosen else 0)


def one_pass(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Assign every distinct vector; the number of rows, the sums of components and the inertia of each cluster."""
    k, width = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 2), object)  # Python's integers: no sum of a task overflows
        for batch in batches:
            x, w = unpacked(batch.column(0).to_pylist(), width), batch.column(1).to_numpy()
            which, d = nearest(x, centroids)
            for c in np.unique(which):
                on = which == c
                own = w[on]
                if int(np.abs(x[on]).max(initial=0)) * int(own.sum()) < 1 << 62 and int(d[on].max()) * int(own.sum()) < 1 << 62:
                    total[c] += [*(own @ x[on]).tolist(), int(own.sum()), int(own @ d[on])]
                else:
                    total[c] += [*(own.astype(object) @ x[on].astype(object)), int(own.sum()), own.astype(object) @ d[on].astype(object)]
        on = [c for c in range(k) if total[c, width]]
        made = [(c, at, str(v)) for c in on for at, v in enumerate(total[c])]
        columns = list(zip(*made, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["cluster", "at", "value"])

    sums = vectors.select("key", "weight").mapInArrow(partial, "cluster int, at int, value string")
    found = sums.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()  # a centroid's components each
    out = np.zeros((k, width + 2), object)
    for r in found:
        out[r["cluster"], r["at"]] = int(r["v"])
    return out[:, width], out[:, :width].tolist(), out[:, width + 1].tolist()


def fit(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """The centroids after so many rounds, and the inertia of each cluster under them.

    An empty cluster keeps its centroid. A round that changes nothing is the last one: those after it would be the same.
    """
    for _ in range(rounds):
        count, sums, inertia = one_pass(vectors, centroids)
        moved = np.array([[s // n for s in own] if n else c.tolist() for n, own, c in zip(count, sums, centroids, strict=True)], np.int64)
        if (moved == centroids).all():
            return centroids, inertia
        centroids = moved
    return centroids, one_pass(vectors, centroids)[2]


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, weight, cluster, distance) of the distinct vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, d = nearest(unpacked(batch.column(0).to_pylist(), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which, pa.int32()), pa.array(d, pa.int64())], names=["key", "weight", "cluster", "distance"])

    return vectors.select("key", "weight").mapInArrow(work, "key binary, weight long, cluster int, distance long")


def joined_back(rows: DataFrame, found: DataFrame, total: int, heavy: int = HEAVY) -> DataFrame:
    """(vec_id, cluster, distance) of (vec_id, key). Vectors that very many rows have go to all tasks, the others are joined
    by key: no key brings more than total / heavy rows to a task."""
    often = F.col("weight") * heavy > total
    few = F.broadcast(found.filter(often).select("key", "cluster", "distance"))  # fewer than heavy rows
    others = rows.join(few.select("key"), "key", "left_anti").join(found.filter(~often).select("key", "cluster", "distance"), "key")
    return rows.join(few, "key").unionByName(others).select("vec_id", "cluster", "distance")


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, scale: int = SCALE, length: int = LENGTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of (vec_id, embedding).

    Vectors that are null, of another length, or hold a null or non-finite component have no row. Repeated rows are rows
    of their own, in the count of a centroid too; null ids are clustered and never chosen first while others are left.
    With fewer than k vectors there are as many centroids. An empty table gives an empty one. Other columns don't matter.
    """
    rows = integer_vectors(embeddings, scale, length=length)
    vectors = distinct_vectors(rows)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return embeddings.sparkSession.createDataFrame([], empty)
    centroids, inertia = fit(vectors, centroids, rounds)
    total = vectors.agg(F.sum("weight")).first()[0]
    out = joined_back(rows, assigned(vectors, centroids), total)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return out.select(
        "vec_id", "cluster", "distance", F.element_at(F.array(*[F.lit(x).cast("long") for x in inertia]), at).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), F.element_at(F.array(*[F.lit(x) for x in digests]), at).alias("centroid_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and distance after ten rounds from eight centroids. Edge cases as in cluster."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    nearest_sql = """SELECT vec_id, q, row, m.c AS cluster, m.d AS distance FROM (SELECT any_value(vec_id) AS vec_id, any_value(q) AS q, row, min({{'d': d, 'c': cluster}}) AS m
FROM (SELECT vec_id, q, row, cluster, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{0}) GROUP BY row)"""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q, row_number() OVER () AS row FROM embeddings WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: isfinite(x))) = {LENGTH})",
        f"c0 AS MATERIALIZED (SELECT cluster, c FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), q) - 1 AS cluster, q AS c FROM v) WHERE cluster < {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED ({nearest_sql.format(r)})")
        if r < ROUNDS:
            mean = f"SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, {LENGTH + 1})) AS i FROM a{r}) GROUP BY ALL)) GROUP BY cluster"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN ({mean}) n USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


ORACLE = _sql()
