import hashlib

import duckdb
import numpy as np
import pytest

from quillspan.llm import clusters as C
from quillspan.llm.vectors import integer_vectors, products, unpacked

SCHEMA = "vec_id long, embedding array<float>, key string, weight long"


def brute(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    at = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, a in at if a == j) for j in range(len(centers))]
    return sorted((str(i), j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at))


def found(spark, rows, **options):
    got = C.cluster(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())


def vectors(seed, n, kinds, spread=0.2):
    r = np.random.default_rng(seed)
    pool = r.normal(0, spread, (kinds, 64)).astype(np.float32)
    return [(int(i), pool[r.integers(kinds) if r.random() > 0.4 else 0].tolist(), "x", 7) for i in range(n)]


@pytest.mark.parametrize(("n", "kinds", "spread"), [(300, 150, 0.2), (200, 5, 0.2), (120, 60, 900.0), (5, 5, 0.2), (1, 1, 0.2)])
def test_clusters_agree_with_brute_force(spark, n, kinds, spread):
    rows = vectors(n, n, kinds, spread)
    assert found(spark, rows) == brute(rows)


def test_nulls_lengths_repeated_rows_and_empty_tables(spark):
    good = vectors(3, 40, 20)
    odd = [(100, None, None, None), (101, [], "", 1), (102, [0.5] * 63, "", 1), (103, [0.5] * 63 + [None], "", 1), (104, [0.5] * 63 + [float("nan")], "", 1), (105, [0.5] * 63 + [float("inf")], "", 1), (None, [0.25] * 64, None, 1)]
    rows = good + good[:7] + odd
    assert found(spark, rows) == brute(rows) and len(found(spark, rows)) == 48
    assert found(spark, []) == [] and found(spark, odd[:6]) == []


def test_a_round_that_changes_nothing_ends_the_rounds(spark):
    rows = [(i, [float(i % 3)] * 64, "", 1) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_vectors_of_many_rows_are_joined_apart(spark):
    rows = vectors(8, 400, 30)
    whole = integer_vectors(spark.createDataFrame(rows, SCHEMA), 1024, length=64)
    distinct = C.distinct_vectors(whole)
    center = C.first_centroids(whole, 8, 3)
    made = [sorted(map(tuple, C.joined_back(whole, C.assigned(distinct, center), 400, heavy).collect())) for heavy in (1, 3, 10_000)]
    assert made[0] == made[1] == made[2] and len(made[0]) == 400


def test_products_are_exact_beyond_floating_point():
    a = np.array([[(1 << 26) + 1, 1], [3, -(1 << 26) - 1]], np.int64)
    assert products(a, a).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(p, q))) for q in a] for p in a]
    assert unpacked([np.array([1, 2], "<i4").tobytes(), b""], 3).tolist() == [[1, 2, 0], [0, 0, 0]]


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="or more in absolute value"):
        found(spark, [(1, [1e9] * 64, "", 1)])


def test_the_query_agrees_with_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    got, want = C.op12_centroid_clusters(spark, d).toPandas(), con.sql(C.ORACLE).df()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[got.columns].values.tolist()))
