"""Written indexes against a full search."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import postings as I
from quillspan.operators import retrieval as R
from quillspan.operators import vector_index as V
from quillspan.sources.scratch import stored

SCHEMA = "id long, vector array<float>"


def clustered(seed, n, kinds, width=12, noise=0.15):
    r = np.random.default_rng(seed)
    pool = r.normal(0, 1, (kinds, width))
    return [(i, (pool[i % kinds] + r.normal(0, noise, width)).astype(np.float32).tolist()) for i in range(n)]


def ranked(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(clustered(1, 1500, 20) + [(5000, None)], SCHEMA).repartition(5)
    path = str(tmp_path_factory.mktemp("cells"))
    V.write_index(rows, path)
    return rows, path


def asked(rows):
    return rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def test_every_row_with_a_vector_is_in_one_cell(spark, index):
    rows, path = index
    held = spark.read.parquet(f"{path}/rows")
    assert held.count() == held.select("id").distinct().count() == 1500
    cells = V.Cells(spark, path)
    assert cells.n.sum() == 1500 and len(cells.cell) <= V.cells_for(1501)


def test_the_exact_search_is_that_of_all_rows_and_reads_fewer(spark, index):
    rows, path = index
    got = V.index_topk(asked(rows), path, 7, probe=2, exact=True, block=9)
    assert ranked(got) == ranked(R.vector_topk(asked(rows), rows, 7))
    assert got.agg(F.avg("share")).first()[0] < 0.6


def test_probing_reads_only_the_folders_of_its_cells(spark, index):
    rows, path = index
    one = V.index_topk(asked(rows).filter("query_id = 0"), path, 5, probe=1)
    assert one.count() == 5 and one.first()["share"] < 0.25 and one.first()["cells"] == 1
    cells = V.Cells(spark, path)
    read = spark.read.schema("id long, vector array<double>, cell int").parquet(f"{path}/rows").filter(F.col("cell").isin([int(cells.cell[0])]))
    assert re.search(r"PartitionFilters: \[[^]]*cell", read._jdf.queryExecution().toString())


def test_recall_with_a_probe_found_on_other_queries(spark, index):
    rows, path = index
    own, others = (rows.filter(f"id % 7 {c} 0").select(F.col("id").alias("query_id"), "vector") for c in ("=", "<>"))
    probe = V.probe_for(others, rows, path, 10)
    out = V.recalls(R.vector_topk(own, rows, 10), V.index_topk(own, path, 10, probe), 10).collect()
    assert len(out) == 215 and sum(r.recall for r in out) / 215 >= 0.9 and sum(r.share for r in out) / 215 < 0.5


def test_the_query_has_nine_tenths_of_the_best_rows(spark):
    from quillspan.plans.indexes import vector_index_recall

    out = vector_index_recall(spark, "/root/testdata/sf0.1").collect()
    assert len(out) == 40 and sum(r.recall for r in out) / 40 >= 0.9 and sum(r.share for r in out) / 40 < 0.9


def test_a_third_of_all_rows_in_one_cell(spark, tmp_path):
    rows = clustered(2, 400, 40) + [(1000 + i, [1.0] * 12) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = V.FILE_ROWS
    V.FILE_ROWS = 50
    try:
        V.write_index(df, str(tmp_path))
    finally:
        V.FILE_ROWS = old
    queries = df.filter("id IN (0, 50, 1000, 1050)").select(F.col("id").alias("query_id"), "vector")
    assert ranked(V.index_topk(queries, str(tmp_path), 6, probe=1, exact=True)) == ranked(R.vector_topk(queries, df, 6))


def test_no_rows_no_queries_and_equal_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    V.write_index(none, str(tmp_path / "none"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    assert V.index_topk(q, str(tmp_path / "none"), 3, 2).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], SCHEMA)
    V.write_index(same, str(tmp_path / "same"))
    assert [r[2] for r in ranked(V.index_topk(q, str(tmp_path / "same"), 3, 2))] == [0, 1, 2]
    assert V.index_topk(q.filter("query_id = 2"), str(tmp_path / "same"), 3, 2).count() == 0


TEXTS = "id long, text string"


def worded(seed, n, words=120, longest=60):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    chance = [1 / (1 + i) for i in range(words)]
    return [(i, " ".join(r.choices(pool, chance, k=r.randint(0, longest)))) for i in range(n)]


def scored(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize(("n", "k", "shard_tokens"), [(400, 5, 1 << 22), (400, 5, 700), (60, 100, 300), (3, 2, 1 << 22)])
def test_postings_find_what_a_scan_finds(spark, tmp_path, n, k, shard_tokens):
    rows = spark.createDataFrame([*worded(n, n), (9000, None), (9001, "w0 " * 3000), (9002, "w0 w1"), (9003, "w0 w1")], TEXTS).repartition(3)
    I.write_postings(rows, str(tmp_path), shard_tokens)
    shards = spark.read.parquet(f"{tmp_path}/postings").select("shard").distinct().count()
    assert shards > 5 if shard_tokens < 1000 and n > 100 else shards <= 15
    queries = spark.createDataFrame([(1, "w0 w1 w2"), (2, "w90 w100 w100 w3"), (3, "none"), (4, ""), (5, None), (6, " ".join(f"w{i}" for i in range(120)))], "query_id long, text string")
    got, work = I.postings_topk(queries, str(tmp_path), k, block=50)
    assert scored(got) == scored(R.bm25_topk(queries.fillna(""), rows, k))
    assert all(0 < r.read <= r.total for r in work.collect())


def test_rows_and_queries_that_are_alike_are_looked_at_once(spark, monkeypatch):
    made = worded(11, 60, 40, 25)
    texts = [(1000 * c + i, t if c % 2 else " ".join(sorted(t.split(), reverse=True))) for c in range(9) for i, t in made if i % (c + 1) == 0]
    rows = spark.createDataFrame([*texts, (9000, None), (9001, " ")], TEXTS).repartition(5)
    held = [(i, t.split()) for i, t in texts] + [(9000, []), (9001, [])]
    df = {w: sum(w in t for _, t in held) for w in {w for _, t in held for w in t}}
    raw = {w: math.log(len(held) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low, mean = 0.25 * sum(raw.values()) / len(raw), sum(len(t) for _, t in held) / len(held)
    weight = {w: low if x < 0 else x for w, x in raw.items()}
    asked = [(q, t) for q, (_, t) in enumerate(held) if q % 3 == 0 and t]
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asked], "query_id long, text string")
    for k, groups in ((4, 1 << 19), (50, 1)):
        monkeypatch.setattr(R, "COPIED_GROUPS", groups)
        got = {}
        for x in R.bm25_topk(queries, rows, k, block=200).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.id, x.score))
        for q, words in asked:
            score = {i: sum(weight[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in words) for i, t in held if set(t) & set(words)}
            best = sorted(score, key=lambda i: (-round(score[i], 6), i))[:k]
            assert [(r, i) for r, i, _ in sorted(got[q])] == list(enumerate(best, 1)) and all(abs(s - score[i]) < 2e-6 for _, i, s in got[q])
    tokens = stored(R.hashed(R.term_counts(rows)), "tokens")
    first, members = R.copies(tokens, 3)
    bags = {tuple(sorted(t)) for _, t in held}
    assert first.count() == len(bags) < len(held) and first.agg(F.sum("n")).first()[0] == len(held)
    assert members.groupBy("first").count().agg(F.max("count")).first()[0] == 3
    assert R.same_queries(stored(R.term_weights(queries, first)[0], "weights")).select("first").distinct().count() == len({tuple(sorted(t)) for _, t in asked})


def test_an_index_holds_rows_that_are_alike_once(spark, tmp_path):
    rows = spark.createDataFrame([(1000 * c + i, t) for c in range(7) for i, t in worded(12, 50, 40, 25) if i % (c + 1) == 0], TEXTS).repartition(5)
    I.write_postings(rows, str(tmp_path), 300)
    kinds = rows.filter("text <> ''").select("text").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/postings").filter("term IS NULL").agg(F.sum("n")).first()[0] == kinds < rows.count()
    queries = rows.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    for k in (3, 60):
        got, work = I.postings_topk(queries, str(tmp_path), k, block=100)
        assert scored(got) == scored(R.bm25_topk(queries, rows, k)) and work.count() == queries.filter("text <> ''").count()


def test_a_search_reads_less_than_the_lists_of_a_query(spark, tmp_path):
    rows = spark.createDataFrame(worded(8, 6000, 2000, 80), TEXTS).coalesce(1)
    I.write_postings(rows, str(tmp_path))
    queries = spark.createDataFrame([(i, f"w0 w1 w2 w{500 + i} w{900 + i}") for i in range(20)], "query_id long, text string")
    got, work = I.postings_topk(queries, str(tmp_path), 3)
    assert scored(got) == scored(R.bm25_topk(queries, rows, 3))
    read, total = work.agg(F.sum("read"), F.sum("total")).first()
    assert read < 0.7 * total


def test_terms_of_negative_weight_only_take_away(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a b" if i else "a c") for i in range(6)], TEXTS)
    I.write_postings(rows, str(tmp_path))
    queries = spark.createDataFrame([(1, "a"), (2, "a c"), (3, "b b c")], "query_id long, text string")
    assert scored(I.postings_topk(queries, str(tmp_path), 4)[0]) == scored(R.bm25_topk(queries, rows, 4))


def test_postings_of_no_rows(spark, tmp_path):
    I.write_postings(spark.createDataFrame([], TEXTS), str(tmp_path))
    got, work = I.postings_topk(spark.createDataFrame([(1, "a")], "query_id long, text string"), str(tmp_path), 3)
    assert got.count() == 0 and work.count() == 0


def test_postings_for_queries_of_many_terms(spark, tmp_path):
    rows = spark.createDataFrame(worded(4, 500, 600, 300), TEXTS).repartition(3)
    queries = rows.filter("id % 25 = 0").withColumnRenamed("id", "query_id")
    I.write_postings(rows, str(tmp_path), 9000)
    for block in (300, 1 << 20):
        got, work = I.postings_topk(queries, str(tmp_path), 9, block=block)
        assert scored(got) == scored(R.bm25_topk(queries, rows, 9)) and all(0 < r.read <= r.total for r in work.collect())
