"""Behaviour of operators on small tables made by hand."""

import random

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import evaluation, filters, graph, markdown, memory, numbering, pages, retrieval, text_ops
from quillspan.operators import understanding as U


def test_vector_topk_is_exact_over_partitions(spark):
    r = random.Random(1)
    data = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(data, "id long, vector array<float>").repartition(7)
    q = df.filter("id < 5").select(F.col("id").alias("query_id"), "vector")
    got = {}
    for x in retrieval.vector_topk(q, df, 4, block=2).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["id"]))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    vec = {r["id"]: r["vector"] for r in df.filter("vector IS NOT NULL").collect()}
    for k, v in got.items():
        assert [i for _, i in sorted(v)] == sorted(vec, key=lambda i: -cos(vec[k], vec[i]))[:4]


def test_bm25_negative_idf_and_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a d d"), (4, "a"), (5, "")], "id long, text string")
    q = spark.createDataFrame([(1, "d d zzz"), (2, "d zzz"), (3, "a")], "query_id long, text string")
    s = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25_topk(q, docs, 10, block=2).collect()}
    assert abs(s[1, 3] - 2 * s[2, 3]) < 2e-6 and (1, 1) not in s and (3, 5) not in s and s[3, 4] != 0


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    score = lambda x, y: {r["id"]: r["rrf"] for r in retrieval.reciprocal_ranks(x, y).collect()}
    assert score(a, b) == score(b, a) and max(score(a, b), key=score(a, b).get) == 11


def test_balanced_selection(spark):
    rows = [(1, i, "A" if i < 8 else "B", i + 1) for i in range(12)]
    out = retrieval.balanced(spark.createDataFrame(rows, "query_id long, chunk_id long, city string, rank int"), 5, 2).orderBy("position").collect()
    assert [r["chunk_id"] for r in out] == [0, 1, 2, 8, 9]


def test_ranking_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id long, id long, rank int")
    judged = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (1, 9, 2)], "query_id long, id long, grade int")
    m = evaluation.ranking_metrics(run, judged).first()
    assert m["mrr"] == 0.5 and m["precision_at_k"] == 0.2 and 0 < m["ndcg"] < 1 and m["pooled_precision"] == 0.2


def test_pearson_edge_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("c", None, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["pearson_r"] for r in evaluation.pearson(df, "x", "y", ["g"]).collect()}
    assert got["a"] is None and got["b"] is None and abs(got["c"] - 1) < 1e-12


def test_memory_upsert_and_profile(spark):
    log = spark.createDataFrame([(1, "budget", "low", 0.5, 1), (1, "budget", "high", 0.4, 2), (1, "budget", "LOW", 0.9, 3), (1, "interest", "art", 0.1, 4)], "user_id long, memory_type string, content string, importance double, seq long")
    up = {(r["memory_type"], r["content"]): (r["importance"], r["is_active"]) for r in memory.upserted(log).collect()}
    assert up == {("budget", "low"): (0.9, True), ("budget", "high"): (0.4, False), ("interest", "art"): (0.1, True)}
    p = memory.profiles(memory.upserted(log)).first()
    assert (p["budget"], p["tone"], p["interests"], p["avoid"]) == ("low", None, "art", "")


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    out = graph.reachable(edges, spark.createDataFrame([(1,)], "root long"))
    assert {(r["node"], r["level"]) for r in out.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_filters_and_relaxation(spark):
    rows = spark.createDataFrame([(1, "A", "North"), (2, "A", "South"), (3, "B", "South")], "chunk_id long, city string, province string")
    q = spark.createDataFrame([(1, "A", "North"), (2, "B", "North")], "query_id long, q_city string, q_province string")
    out = filters.relaxed(q, rows, F.col("province") == F.col("q_province"), F.col("city") == F.col("q_city")).collect()
    assert {(r["query_id"], r["chunk_id"], r["relaxed"]) for r in out} == {(1, 1, False), (2, 3, True)}


def test_text_rules(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(T.normal_url, "HTTP://www.Ex.com//a//b/?x=1#y") == "http://ex.com/a/b"
    assert one(T.safe_url, "javascript:alert(1)") is None and one(T.safe_url, "https://a.b") == "https://a.b"
    assert one(T.source_kind, "https://x.gov.vn/a") == "official_government"
    assert one(U.freshness, "the climate and weather in june") == "stable" and one(U.freshness, "weather") == "live"
    assert one(lambda t: U.budgets(t), "not a very cheap place") == [] and one(lambda t: U.budgets(t), "avoid luxury; a cheap place in the end, though luxury of mind") == ["budget", "luxury"]
    assert one(filters.without_useless_lines, "# 3\n3\nPage 1 of 9\n- 4\n*** ***\nTel: \nreal words here") == "# 3\n- 4\nreal words here"


def test_recursive_split_keeps_all_words_within_size():
    text = " ".join(f"word{i}." for i in range(400)) + "\n\n" + "x" * 500
    out = text_ops.split_recursively(text, 200, 40)
    assert all(len(c) <= 200 for c in out) and {w for c in out for w in c.split()} >= {f"word{i}." for i in range(400)}


def test_header_sections_and_context(spark):
    df = spark.createDataFrame([(1, "intro\n# A\na\n## B\nb\n# C\nc")], "k long, t string")
    s = text_ops.with_heading_context(text_ops.header_sections(df, "k", "t"))
    assert [(r["section_heading"], r["chunk_text"]) for r in s.orderBy("section").collect()] == [(None, "intro"), ("A", "Section: A\n\na"), ("B", "Section: A > B\n\nb"), ("C", "Section: C\n\nc")]


def test_short_pieces_merge(spark):
    df = spark.createDataFrame([(1, 0, "a" * 10), (1, 1, "b" * 200), (1, 2, "c" * 20)], "k long, pos int, t string")
    out = [r["t"] for r in text_ops.merge_short(df, "k", "pos", "t").orderBy("position").collect()]
    assert out == ["a" * 10 + "\n\n" + "b" * 200 + "\n\n" + "c" * 20]


def test_pages_become_markdown(spark):
    page = "<html><head><title>x</title></head><body><nav>menu</nav><div class='sidebar'>side</div><!-- c --><article><h1>T</h1><p>one <a href='/x'>two</a></p><p>one <a href='/x'>two</a></p><ul><li>i</li></ul><table class='infobox'><tr><td>z</td></tr></table></article><script>z</script></body></html>"
    df = spark.createDataFrame([(1, page, "https://a.org/p/"), (2, None, None), (3, "<p>no end <b>bold", "")], "k long, html string, url string")
    got = {r["k"]: r["markdown"] for r in pages.pages_to_markdown(df, "k", "html", "url").collect()}
    assert got == {1: "# T\n\none [two](https://a.org/x)\n\n- i", 2: "", 3: "no end **bold**"}
    assert "side" in pages.whole_body(page, "") and pages.longest_paragraphs(page, "") == ""
    assert pages.tree_of("<div>" * 20_000 + "deep").text() == "deep"


CLEANED = [
    ("##Title\r\n##**Bold** \n**Bold line**\n* item  two ,x\n\n\n\n<b>t</b>", "## Title\n## Bold\n\n## Bold line\n\n* item two,x\n\nt"),
    ("a &amp; b<br/>c", "a & b\nc"), ("**==> picture [1] <==**\nx", "x"), ("![i](u) x < 3", "x < 3"), ("## Head**Long text.**", "## Head\n\nLong text."),
    ("karsts**Da Nang** Breezy", "karsts\n\n## Da Nang\n\nBreezy"), ("__u__ _it_ snake_case_x ~~no~~", "u it snake_case_x no"), ("1Title here - text", "1. Title here - text"),
    ("2 Another title\n2026 Vietnam guide", "2. Another title\n2026 Vietnam guide"), ("\u2022item\n#### \nend  ", "- item\n\nend"), ("foot\nx\nfoot\ny\nfoot", "x\ny"), (None, ""), ("", ""),
    ("a\n----- Start of picture text -----\nshort\n----- End of picture text -----\nb", "a\nb"),
    ("a\n--- start of picture text ---\n" + "word " * 20 + "\n\n\n x \n--- end of picture text ---\nb", "a\n\n### Image OCR Text\n\n" + ("word " * 20).strip() + "\nx\n\nb"),
    ("a\n--- end of picture text ---\nb", "a\n\nb"),
]


def test_markdown_is_cleaned_step_by_step(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "i long, t string")
    got = {r["i"]: r["t"] for r in markdown.cleaned(df, "t").collect()}
    assert {CLEANED[i][0]: t for i, t in got.items()} == dict(CLEANED)


def test_blocks_are_kept_once(spark):
    long = "w" * 200
    text = f"# A\n\none [x](y) two\n\nOne two!\n\n# A\n\n{long} a\n\n{long} b\n\n***\n\nlast"
    out = spark.createDataFrame([(text,)], "t string").select(markdown.deduplicated_blocks(F.col("t"))).first()[0]
    assert out == f"# A\n\none [x](y) two\n\n# A\n\n{long} a\n\nlast"


def folded(pieces, least=150, most=1200):
    """Short pieces by hand: forward within a section, else backward, else as they are."""
    left, out = [list(p) for p in pieces if p[1].strip()], []
    while left:
        s, t = left.pop(0)
        if len(t) < least and left and left[0][0] == s and len(t) + 2 + len(left[0][1]) <= most:
            left[0][1] = t + "\n\n" + left[0][1]
        elif len(t) < least and out and out[-1][0] == s and len(out[-1][1]) + 2 + len(t) <= most:
            out[-1][1] += "\n\n" + t
        else:
            out.append([s, t])
    return [t for _, t in out]


def test_short_pieces_merge_within_their_section(spark):
    import random

    r = random.Random(3)
    rows = [(k, i, f"h{i // r.randrange(1, 5)}", "x" * r.choice((0, 20, 100, 149, 150, 400, 1100, 1190))) for k in range(60) for i in range(r.randrange(1, 12))]
    out = text_ops.merge_short(spark.createDataFrame(rows, "k long, pos int, h string, t string"), "k", "pos", "t", "h").collect()
    for k in range(60):
        assert [x["t"] for x in sorted((x for x in out if x["k"] == k), key=lambda x: x["position"])] == folded([(h, t) for q, _, h, t in rows if q == k])


def test_names_regions_and_stays(spark):
    names = ["Da Nang", "Hoi An", "Hue"]
    one = lambda c, s: spark.createDataFrame([(s,)], "t string").select(c(F.col("t"))).first()[0]
    found = lambda s: one(lambda t: U.explicit_names(t, names), s)
    assert found("hue and HOI AN!") == ["Hoi An", "Hue"] and found("Hue Imperial Museum") == [] and found("Hue City, huey") == ["Hue"] and found("the Hue Citadel near Hue") == ["Hue"]
    assert one(lambda t: U.located(t, F.lit("Hue")), "in  the North of Vietnam") == ("northern_vietnam", None) and one(lambda t: U.located(t, F.lit("Hue")), "northern") == (None, "Hue")
    rows = [(1, 0, "we are ending in Hue"), (1, 1, "a photographer, finishes in Da Nang"), (1, 2, "where can I stay for the last TWO nights"), (1, 3, "ends in Hoi An"), (2, 0, "hotel for the final 3 nights"), (2, 1, "ending in Hue")]
    got = {(r["k"], r["n"]): r["rewritten"] for r in U.stay_rewrites(spark.createDataFrame(rows, "k long, n int, t string"), names, "k", ("n",), "t").collect()}
    assert got[1, 2] == "Where should I stay in Da Nang for the final 2 nights of the existing photography itinerary?" and [v for v in got.values() if v] == [got[1, 2]]


def test_plans_are_made_consistent(spark):
    tasks = "array(named_struct('query', 'q1', 'cities', array('Hue', 'X'), 'indexes', array(2, 0, 2, 9)), named_struct('query', ' ', 'cities', array('Da Nang'), 'indexes', array(0)))"
    df = spark.createDataFrame([(["a", " ", "b", "c"], ["Hue", "Ha Long"])], "r array<string>, c array<string>")
    dropped = F.transform("r", lambda x: x == "a")
    p = df.select(U.normal_plan(F.lit("see"), F.col("r"), F.expr(tasks), dropped, F.col("c")).alias("p")).first()["p"]
    assert p["requirements"] == ["b", "c"] and [(t["query"], t["cities"], t["indexes"]) for t in p["tasks"]] == [("Ha Long see", ["Ha Long"], [0, 1]), ("q1", ["Hue"], [0])]
    none = df.select(U.normal_plan(F.lit("see"), F.col("r"), F.expr(tasks), F.transform("r", lambda x: F.lit(True)), F.array().cast("array<string>")).alias("p")).first()["p"]
    assert none["requirements"] == ["Factual evidence needed to answer the travel request"] and [t["cities"] for t in none["tasks"]] == [["Hue", "X"]]


def test_weak_metrics_by_hand(spark):
    empty = []
    cases = spark.createDataFrame([(1, [5, 9], empty, empty, empty), (2, empty, ["old gate", "lake"], ["hue"], ["food"]), (3, empty, empty, empty, empty)], "query_id long, relevant array<long>, places array<string>, locations array<string>, keywords array<string>")
    run = spark.createDataFrame([(1, 4, 1, "x"), (1, 5, 2, "x"), (2, 1, 1, "hue food"), (2, 2, 2, "the Old_Gate"), (2, 3, 11, "lake")], "query_id long, id long, rank int, text string")
    m = {r["query_id"]: r for r in evaluation.weak_metrics(run, cases).collect()}
    log = 1.584962500721156
    assert m[1]["recall"] == 0.5 and m[1]["precision"] == 0.1 and m[1]["mrr"] == 0.5 and abs(m[1]["ndcg"] - (7 / log) / (7 + 7 / log)) < 1e-9
    assert m[2]["recall"] == 0.5 and m[2]["mrr"] == 1.0 and abs(m[2]["ndcg"] - (3 + 7 / log) / (7 + 7 / log)) < 1e-9 and m[3]["ndcg"] == m[3]["recall"] == 0.0


def test_numbers_and_carried_values_in_slices(spark):
    rows = [(i % 2 if i % 7 else None, i, "v" if i % 5 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i long, v string")
    got = {r["i"]: (r["n"], r["size"]) for r in numbering.numbered(df, ["g"], [F.desc("i")], "n", "size").collect()}
    groups = {g: sorted((i for h, i, _ in rows if h == g), reverse=True) for g in (0, 1, None)}
    assert got == {i: (k + 1, len(x)) for x in groups.values() for k, i in enumerate(x)}
    held = {r["i"]: (r["previous"], r["known"]) for r in numbering.carried(df, ["g"], ["i"], "v").collect()}
    for x in groups.values():
        known, previous = None, None
        for i in sorted(x):
            assert held[i] == (previous, known)
            previous = rows[i][2]
            known = previous or known


def test_repeated_lines_stay_where_safe(spark):
    df = spark.createDataFrame([(1, "foot\nx\nfoot\n- foot\nfoot\n- foot\n- foot"), (2, "")], "k long, t string")
    assert {r["k"]: r["t"] for r in df.select("k", markdown.without_repeated_lines(F.col("t")).alias("t")).collect()} == {1: "x\n- foot\n- foot\n- foot", 2: ""}


def test_queries_of_many_terms_are_scored_by_products(spark):
    import time

    import numpy as np

    from quillspan.operators import scoring

    r = np.random.default_rng(5)
    n, words, asked, k = 6000, 3000, 300, 7
    chance = 1 / (1 + np.arange(words))
    chance /= chance.sum()
    rows = [np.unique(r.choice(words, 250, p=chance), return_counts=True) for _ in range(n)]
    ids, weights = r.permutation(n), r.normal(1.0, 1.0, words).round(3)
    query = np.repeat(np.arange(asked), [len(rows[q][0]) for q in range(asked)])
    term = np.concatenate([rows[q][0] for q in range(asked)])
    best = scoring.Product(scoring.Search(np.arange(asked), query, term, weights[term], 250.0, k), words)
    dense = np.zeros((n, words))
    for i, (t, c) in enumerate(rows):
        dense[i, t] = scoring.gain(c, np.full(len(c), 250), 250.0)
    began = time.time()
    for at in range(0, n, 2000):
        own = rows[at : at + 2000]
        t, row = np.concatenate([x[0] for x in own]), np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
        best.shard(ids[at : at + 2000], t, row, dense[at + row, t])
    assert time.time() - began < 10
    got = {}
    for batch in best.found():
        for q, i, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "id", "score")), strict=True):
            got.setdefault(q, []).append((i, s))
    for q in range(asked):
        full = (dense[:, rows[q][0]] @ weights[rows[q][0]]).round(6)
        order = np.lexsort((ids, -full))[:k]
        assert [i for i, _ in got[q]] == ids[order].tolist() and np.allclose([s for _, s in got[q]], full[order], atol=2e-6)


def test_scans_hold_a_bounded_number_of_rows_and_score_in_double_precision(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quillspan.operators import scoring

    r = np.random.default_rng(11)
    n, k = 40_000, 5
    lengths = r.integers(1, 4, n)
    terms = [np.sort(r.choice(50, x, replace=False)) - 25 for x in lengths]
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (np.concatenate(terms).astype(np.int64), np.ones(ends[-1], np.int32))]
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(lengths.astype(np.int32)), *lists], names=["id", "length", "terms", "counts"])
    known = np.arange(-25, 15)
    query, term = np.repeat(np.arange(40), 8), np.concatenate([r.choice(40, 8, replace=False) for _ in range(40)])
    weight = r.normal(1.0, 1.0, len(term)) * 1000
    sizes, take = [], scoring.Product.shard
    monkeypatch.setattr(scoring.Product, "shard", lambda self, ids, *rest: (sizes.append(len(ids)), take(self, ids, *rest)))
    scan = scoring.Scan(scoring.Search(np.arange(40), query, term, weight, 2.0, k), known, 1.5, 0.75)
    got = [x for batch in scan(whole.slice(at, 1000) for at in range(0, n, 1000)) for x in zip(*(batch.column(c).to_pylist() for c in ("query_id", "id", "score")), strict=True)]
    assert sum(sizes) == n and max(sizes) <= scoring.SHARD_ROWS + 256
    dense = np.zeros((n, 50))
    dense[np.repeat(np.arange(n), lengths), np.concatenate(terms) + 25] = np.repeat(scoring.gain(np.ones(n), lengths, 2.0), lengths)
    for q in range(40):
        own = term[query == q]
        full = (dense[:, own] @ weight[query == q]).round(6)
        has = np.flatnonzero((dense[:, own] > 0).any(axis=1))
        best = has[np.lexsort((has, -full[has]))[:k]]
        mine = [x for x in got if x[0] == q]
        assert [x[1] for x in mine] == best.tolist() and np.allclose([x[2] for x in mine], full[best], atol=2e-6)


def test_pearson_of_a_constant_in_many_partitions_is_null(spark):
    # Groups by 20 have one remainder by 5 each, in partitions of many sizes: their merged deviations needn't be 0.
    df = spark.range(0, 51282, 1, 11).selectExpr("id % 20 AS g", "(id % 101) * 1e-2 AS x", "1e0 + id % 5 AS y")
    assert [r["pearson_r"] for r in evaluation.pearson(df, "x", "y", ["g"]).collect()] == [None] * 20


def test_terms_are_counted_by_the_tokens_of_texts(spark):
    from quillspan.functions.text import tokens

    texts = [None, "", " \t\n", "a", " a  b\x0ba\x0c\r\nc ", "x\x1cy z \x85", "é É é é", "a" * 70000 + " b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    want = {r["id"]: r["t"] or [] for r in rows.select("id", tokens(rows["text"]).alias("t")).collect()}
    got = {r["id"]: r for r in retrieval.term_counts(rows).collect()}
    assert sorted(got) == sorted(want)
    for i, t in want.items():
        assert got[i]["length"] == len(t) and len(got[i]["terms"]) == len(set(got[i]["terms"])) == len(set(t))
        assert sorted(got[i]["counts"]) == sorted(t.count(x) for x in set(t))
    assert set(got[3]["terms"]) < set(got[4]["terms"])  # a word is the same term in every row


def test_metrics_ask_for_no_more_ranks_than_they_read(spark, monkeypatch):
    from quillspan.plans import analytics

    asked, ranks = [], analytics.lexical_ranks
    monkeypatch.setattr(analytics, "lexical_ranks", lambda spark, d, k: (asked.append(k), ranks(spark, d, k))[1])
    d = "/root/testdata/sf0.001"
    few = {tuple(r) for r in analytics.precision_at_5(spark, d).collect()}
    gain = {tuple(r) for r in analytics.ndcg_at_5(spark, d).collect()}
    analytics.stage_metrics(spark, d)
    assert asked == [5, 5, 200]
    all_ranks = analytics.metrics(spark, d, 200)
    assert few == {tuple(r) for r in all_ranks.select("query_id", "precision_at_k").collect()}
    assert gain == {tuple(r) for r in all_ranks.select("query_id", "ndcg").collect()}
