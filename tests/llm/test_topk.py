import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import topk as T
from quillspan.llm.vectors import integer_vectors


def brute(rows, k=20, every=20):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(kept) if a != b)
            out += [(i, r + 1, str(None if void else j), -s) for r, (s, void, j) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, parts=3, k=20, **options):
    whole = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts), 64)
    numbered = T.materialize(whole.withColumn("row", F.monotonically_increasing_id()), "numbered")
    got = T.top_products(numbered, numbered.filter("vec_id % 20 = 0"), k, **options)
    return sorted((r.query_id, r["rank"], str(r.vec_id), r.score) for r in got.collect())


def vectors(seed, n, width=16, kinds=None):
    r = np.random.default_rng(seed)
    pool = r.normal(0, 0.4, (kinds or n, width)).astype(np.float32)
    return [(i, pool[i % len(pool)].tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "kinds", "options"), [(400, None, {}), (400, 7, {}), (300, None, {"lists": 1}), (300, 30, {"lists": 16, "block": 3}), (15, None, {}), (21, None, {}), (200, 1, {})])
def test_the_best_rows_agree_with_brute_force(spark, n, kinds, options):
    rows = vectors(n, n, kinds=kinds)
    assert found(spark, rows, **options) == brute(rows)


def test_tiles_and_shortening_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE_ROWS", 7)
    monkeypatch.setattr(T, "TILE_QUERIES", 3)
    block = T.Queries(np.arange(5), np.arange(5), [np.arange(4, dtype="<i4").tobytes()] * 5, 2)
    tiles = list(block.tiles(np.arange(20), [np.ones(4, "<i4").tobytes()] * 20))
    assert len(tiles) == 6 and sum(own.sum() for *_, own in tiles) == 5 and all(sum(local).max() == 6 for _, _, local, _ in tiles)


def test_nulls_lengths_ties_repeated_rows_and_empty_tables(spark):
    good = vectors(4, 60)
    odd = [(200, None), (220, []), (240, [0.5]), (260, [0.5, None]), (280, [float("nan")]), (300, [float("-inf")] * 16), (None, [9.0] * 16), (None, [9.0] * 16)]
    rows = good + good[:3] + good[:1] + odd
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(20, [1.0])]) == [] and found(spark, [(1, [1.0])]) == []


def test_the_cutoff_leaves_few_rows_out_of_many():
    r = np.random.default_rng(2)
    q, x = r.integers(-60, 60, (5, 64)), r.integers(-60, 60, (4000, 64))
    local, own = [q[:, p] @ x[:, p].T for p in np.array_split(np.arange(64), 4)], np.zeros((5, 4000), bool)
    best = np.sort(T.best_totals(local, own, 20), axis=1)
    truth = np.sort(q @ x.T, axis=1)[:, -20:]
    assert (best[:, 0] <= truth[:, 0]).all()  # safe: no cutoff is over the true one
    a, b, total = T.sufficient(local, own, best[:, 0], best[:, 0])
    assert len(a) < 5 * 200 and all((np.sort(total[a == i])[-20:] == truth[i]).all() for i in range(5))


def test_the_query_agrees_with_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    got, want = T.op13_exact_top_products(spark, d).toPandas(), con.sql(T.ORACLE).df()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[got.columns].values.tolist()))
