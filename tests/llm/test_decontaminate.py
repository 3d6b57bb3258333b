import re

from quillspan.llm import decontaminate as D


def brute(docs, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))
    sh = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out, asked = [], [(i, len(w), sh(w, min(5, len(w)))) for i, w in ((i, words(x)) for i, x in items) if w]
    for d, t in docs:
        held = {n: sh(words(t), n) for n in range(1, 6)}
        for i, n, s in asked:
            own = held[min(5, n)]
            if s and len(s & own) >= 0.8 * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(out, key=str)


def run(spark, docs, items, block=D.BLOCK_WORDS):
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = D.find_items(df, it, block=block).collect()
    return sorted(((r.doc_id, h.item_id, h.n_shingles, h.n_shared) for r in out for h in r.hits), key=str)


def test_matches_brute_force_with_cut_passages(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for k, (i, t) in enumerate(items):
        w = t.split()
        docs.append((10_000 + k, " ".join(["lead"] * 50 + w[: len(w) - k % 12] + ["tail"] * k)))
        docs.append((20_000 + k, " ".join([*w[: len(w) // 2], "CHANGED", *w[len(w) // 2 :]])))
    items += [(900, "LEAD  lead lead\tLEAD"), (901, "tail"), (902, "never found here"), (903, "tail tail tail tail tail")]
    want = brute(docs, items)
    assert len(want) > 40 and run(spark, docs, items) == want
    assert run(spark, docs, items, block=300) == want
    assert run(spark, docs, items, block=40) == want  # most items are longer than a block


def test_edge_rows(spark):
    item = "one two three four five six seven"
    docs = [(1, None), (2, ""), (None, f"x {item} y"), (3, item.upper()), (3, item.upper()), (4, "one two three four"), (5, "word " * 100_000 + item)]
    items = [(1, item), (1, item), (2, "one two"), (3, None), (None, item)]
    got = run(spark, docs, items)
    assert [(d, i) for d, i, _, _ in got] == sorted([(d, i) for d in (None, 3, 3, 5) for i in (1, 2, None)] + [(4, 2)], key=str)
    assert run(spark, docs, [(1, None)]) == [] and run(spark, [], items) == []


def test_decontaminate_keeps_clean_documents_and_columns(spark):
    item = "one two three four five six seven"
    df = spark.createDataFrame([(1, item, "a", 5), (2, "clean text stays here as it is", None, 6)], "doc_id long, text string, hits string, n long")
    out = D.decontaminate(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [2]


def test_ties_and_equal_items(spark):
    items = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "A B C D E F"), (4, "a b"), (5, "a b")]
    assert [(d, i) for d, i, _, _ in run(spark, [(9, "a b c d e f"), (9, "a b c d e f")], items)] == [(9, i) for i in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5)]


def test_blocks_are_passes_of_their_own(spark):
    """However many blocks the items are, no stage has more than one Python node after another."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)] + [(99, " ".join(f"long{j}" for j in range(900)))]
    docs = [(1, items[3][1]), (2, "nothing"), (3, items[-1][1]), (4, " ".join(items[-1][1].split()[:600])), (5, items[-1][1] + " " + items[0][1])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = D.find_items(df, it, block=200)
    assert {(r.doc_id, tuple(h.item_id for h in r.hits)) for r in out.collect()} == {(1, (3,)), (2, ()), (3, (99,)), (4, ()), (5, (0, 99))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1
    named = df.selectExpr("doc_id", "text", "1 AS h1", "2 AS hits", "3 AS `row`")
    got = D.find_items(named, it, block=200)
    assert got.columns == ["doc_id", "text", "h1", "row", "hits"] and got.filter("size(hits) > 0").count() == 3
    assert D.decontaminate(named, it).columns == named.columns
