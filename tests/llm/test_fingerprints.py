import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from quillspan.llm import fingerprints as P


def words(text):
    low = text.lower()
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text, n=5):
    """Shingles as Spark hashes them: XXH64 of the words, chained."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
    if not h:
        return set()
    return {tuple(h[i : i + n]) for i in range(len(h) - n + 1)} if len(h) >= n else {tuple(h)}


def brute(rows):
    """(doc_id, edited text) in descending doc_id, nulls last, equal ids by text; the next after the last is the first."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((d, t, t[: len(t) - half] + nxt[:half], nxt))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, slices=None, tolerance=0.2):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.text, r.edited_text, r.n_chars) for r in P.edited_fingerprints(df, slices=slices).collect()))
    assert got == sorted((str(d), t, e, len(t)) for d, t, e, _ in brute(rows))
    # Repeated rows have different next documents, so rows are paired by id, text and edited text.
    near = sorted((str(r.doc_id), r.text, r.edited_text, r.near_edited, r.near_next, len(r.sketch)) for r in P.edited_fingerprints(df, slices=slices).collect())
    want = sorted((str(d), t, e, jaccard(shingles(t), shingles(e)), jaccard(shingles(t), shingles(n)), n) for d, t, e, n in brute(rows))
    for (_, t, _, ne, nn, k), (_, _, e, je, jn, nxt) in zip(near, want, strict=True):
        assert k == min(P.K, len(shingles(t)))
        for est, true, other in ((ne, je, e), (nn, jn, nxt)):  # below K shingles in the union the estimate is exact
            assert abs(est - true) < (1e-12 if len(shingles(t) | shingles(other)) <= P.K else tolerance)


def test_edge_rows(spark):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (5, "another text"), (None, "null id"), (None, None), (9, ""), (7, None), (3, "é ü " * 40), (-4, "x"), (8, "w " * 3000)]
    check(spark, rows)
    check(spark, rows, slices=3)


def test_small_tables(spark):
    check(spark, [(1, "alone in the table it is")])
    check(spark, [(None, "a b c"), (None, "d e f")])
    check(spark, [(1, "first text here"), (2, "second text there")])
    assert P.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)
    check(spark, rows, slices=150)


def test_query_digests(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {i: hashlib.sha256(e.encode()).hexdigest() for i, _, e, _ in brute(rows)}
    out = P.op9_document_fingerprints(spark, d).collect()
    assert {r.doc_id: r.edited_sha256 for r in out} == want
    by_text = {}
    for r in out:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_sketches_merge_and_estimate(spark):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    a, b = text(3000), text(1000)
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (2, b)], "g long, t string")
    sk = P.with_sketch(df, "t", "s")
    merged = {x.g: x.s for x in P.merge_sketches(sk, ["g"], "s").collect()}
    parts = [x.s for x in sk.filter("g = 1").collect()]
    assert merged[1] == sorted(set(parts[0]) | set(parts[1]))[: P.K] and merged[2] == sk.filter("g = 2").first().s
    one = spark.createDataFrame([(merged[1], merged[2])], "a array<long>, b array<long>")
    x = one.select(P.merged(F.col("a"), F.col("b")).alias("m"), P.resemblance(F.col("a"), F.col("b")).alias("j"), P.containment(F.col("b"), F.col("a")).alias("c"), P.distinct_shingles(F.col("a")).alias("n")).first()
    assert x.m == merged[1] and abs(x.j - 0.25) < 0.12 and x.c > 0.6 and abs(x.n - 3992) < 0.3 * 3992


def test_columns_of_any_name_come_through_a_sketch(spark):
    df = spark.createDataFrame([("a b c d e f", 1, 2, 3)], "text string, __words int, __all int, __words_ int")
    out = P.with_sketch(df, "text", "sketch")
    assert out.columns == [*df.columns, "sketch"] and tuple(out.first())[1:4] == (1, 2, 3) and len(out.first()["sketch"]) == 2
