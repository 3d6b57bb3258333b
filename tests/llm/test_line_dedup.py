from collections import defaultdict

from quillspan.llm import line_dedup as ld

LONG = "this line is certainly long enough"


def brute(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in ld.dedup_lines(df).collect()), key=str)


def test_edge_rows(spark):
    rows = [
        (1, f"{LONG}\nshort\n{LONG.upper()}"), (2, f"a\n  {LONG}\t\nb"), (3, f"{LONG}\n{LONG}"), (3, f"{LONG}\n{LONG}"), (4, None), (5, ""), (None, LONG), (None, None),
        (6, "É" + LONG), (7, "é" + LONG), (8, "É" + LONG), (9, "\n" * 200 + f"{LONG}x"), (10, f"{LONG}x"), (11, f"{LONG}x\n" * 70), (12, "short\nshort"), (13, f"{LONG}\r"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_repeated_rows_are_one_document(spark):
    rows = [(1, LONG), (1, LONG), (1, LONG), (2, LONG)]
    assert run(spark, rows) == brute(rows) and all(r[3] == 0 for r in run(spark, rows))


def test_clashing_columns_give_way(spark):
    df = spark.createDataFrame([(1, LONG, "x", "y")], "doc_id long, text string, n_lines string, note string")
    assert ld.dedup_lines(df).columns == ["doc_id", "text", "note", "n_lines", "n_dropped"]


def test_hot_line_and_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text + f"\n{LONG}") for r in docs]
    assert run(spark, rows) == brute(rows)


def test_frequent_hashes_are_dealt_to_runs(spark):
    rows = [(i if i else None, f"{LONG}\nown line of document number {i}\n{'x' * 30 if i < 3 else ''}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = ld.line_hashes(df)
    assert [r.runs for r in ld.frequent_hashes(hashes, 40).collect()] == [8] and ld.frequent_hashes(hashes).count() == 0
    out = ld.apply_bitmaps(df, ld.keep_bitmaps(df, run_rows=40))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == brute(rows)


def test_the_stream_is_one_exchange_and_one_sort(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    plan = ld.streamed(ld.line_hashes(df).selectExpr("*", "cast(doc % 2 as int) as run"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "rangepartitioning" in plan and "Window" in plan


def test_internal_names_can_be_columns(spark):
    df = spark.createDataFrame([(1, LONG, 1, 2), (2, LONG, 3, 4), (3, LONG, 5, 6)], "doc_id long, text string, `row` int, dropped int")
    assert sorted(map(tuple, ld.dedup_lines(df).collect())) == [(1, "", 1, 2, 1, 1), (2, "", 3, 4, 1, 1), (3, LONG, 5, 6, 1, 0)]
