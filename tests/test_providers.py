"""Providers and sinks."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.plans.more import greedy_matches, repaired
from quillspan.sources import providers, sinks


def test_failures_are_retried_then_named():
    calls = []

    def flaky(inputs):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("down")
        return [x * 2 for x in inputs]

    waits = []
    assert providers.retried(flaky, sleep=waits.append)([1, 2]) == ([2, 4], None) and waits == [1.0, 2.0]
    out, error = providers.retried(lambda x: [1], sleep=waits.append)([1, 2])
    assert out == [None, None] and "1 outputs for 2 inputs" in error


def test_only_public_destinations_are_fetched():
    ok = lambda u, ips=("93.184.216.34",): providers.public_destination(u, lambda h: list(ips))
    assert ok("https://a.org/x") and not ok("ftp://a.org") and not ok("https://u:p@a.org") and not ok("https://a.org:8080")
    assert not ok("http://127.0.0.1/") and not ok("http://a.org", ("10.0.0.1",)) and not ok("http://[::1]/") and not ok(None) and not ok("http://a.org", ())
    fetch = providers.fetcher(lambda u: b"x" * (3 if "small" in u else 3_000_000))()
    assert not ok("http://2130706433/") and not ok("http://0x7f.1/") and not ok("http://172.16.0.1/") and not ok("http://169.254.9.9/")
    got = fetch(["http://93.184.216.34/small", "http://93.184.216.34/big", "http://127.0.0.1/small"])
    assert [(g["page"], g["reason"]) for g in got] == [("xxx", None), (None, "over 2000000 bytes"), (None, "not a public destination")]


def test_provided_keeps_rows_and_errors(spark):
    def broken():
        def call(inputs):
            raise RuntimeError("no model")

        return call

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    out = providers.provided(df, "t", "v", "array<float>", broken, sleep=lambda s: None).collect()
    assert [(r["id"], r["v"], r["v_error"]) for r in out] == [(1, None, "RuntimeError: no model"), (2, None, "RuntimeError: no model")]
    vec = providers.hashed_embedder()()(["a b", "", "a b"])
    assert vec[0] == vec[2] and sum(vec[1]) == 0 and len(vec[0]) == providers.DIMENSION
    assert providers.overlap_reranker()([("a b", "b c"), (None, "x")]) == [0.5, 0.0]


def test_appends_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    assert sinks.append_new(df, path, ["id"]).count() == 2
    assert sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, ["id"]).count() == 1
    assert spark.read.parquet(path).count() == 3


def test_last_status_update_wins(spark):
    q = spark.createDataFrame([(1, "pending"), (2, "pending")], "url_id long, status string")
    u = spark.createDataFrame([(1, "failed", "x", 1), (1, "completed", None, 2)], "url_id long, status string, error_message string, seq int")
    assert {(r["url_id"], r["status"], r["error_message"]) for r in sinks.merged_status(q, u).collect()} == {(1, "completed", None), (2, "pending", None)}


def test_reports_and_events(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id long, tags array<string>")
    sinks.csv_report(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first()["tags"] == '["a","b"]'
    sinks.ndjson(df.select(sinks.stage_event(F.lit("stage"), id=F.col("id")).alias("value")), str(tmp_path / "nd"))
    assert spark.read.text(str(tmp_path / "nd")).first()["value"] == '{"type":"stage","id":1}'
    sinks.markdown_files(df.select("id", F.lit("# T").alias("md")), "id", "md", str(tmp_path / "md"))
    held = spark.read.json(str(tmp_path / "md")).first()
    assert (held["id"], held["markdown"]) == (1, "# T") and len(list((tmp_path / "md").glob("folder=*"))) == 1


def test_small_rules():
    assert repaired("Ã©tÃ©") == "été" and repaired("été") == "été" and repaired(None) is None
    assert greedy_matches(["art", "food"], ["modern art", "art"]) == 1 and greedy_matches(["a"], []) == 0


def test_pages_of_pdf_files(spark):
    import zlib

    from quillspan.sources import pdf

    packed = zlib.compress(b"BT (Two \\(2\\)) Tj 0 -14 Td (next \\351) Tj ET")
    good = b"%PDF-1.5\n1 0 obj << /Type /Page /Contents 3 0 R >> endobj 2 0 obj<</Type/Page/Contents[4 0 R]>>endobj\n3 0 obj << >> stream\nBT (One) Tj ET\nendstream endobj\n4 0 obj << /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj"
    rows = [(1, bytearray(good)), (2, bytearray(b"hello")), (3, bytearray(b"%PDF-1.4 /Encrypt")), (4, bytearray(b"%PDF-1.4")), (5, None)]
    got = sorted(((r["k"], r["page"], r["text"], r["reason"]) for r in pdf.pdf_pages(spark.createDataFrame(rows, "k long, c binary"), "k", "c").collect()), key=str)
    assert got == [(1, 1, "One", None), (1, 2, "Two (2)\nnext \u00e9", None), (2, None, None, "not a PDF"), (3, None, None, "encrypted"), (4, None, None, "no pages"), (5, None, None, "not a PDF")]


def test_pages_come_in_the_order_of_their_tree_and_from_object_streams():
    import zlib

    import pytest

    from quillspan.sources import pdf

    text = lambda n, t: b"%d 0 obj << >>\nstream\nBT (%s) Tj ET\nendstream\nendobj\n" % (n, t)
    leaf = lambda c: b"<< /Type /Page /Contents %d 0 R >>" % c
    plain = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 9 0 R >> endobj\n" + text(20, b"first") + text(21, b"second") + text(22, b"third") + b"2 0 obj " + leaf(22) + b" endobj 3 0 obj " + leaf(20) + b" endobj 4 0 obj " + leaf(21) + b" endobj\n"
    tree = b"9 0 obj << /Type /Pages /Kids [8 0 R 2 0 R 9 0 R] >> endobj 8 0 obj << /Type /Pages /Kids 7 0 R >> endobj 7 0 obj [3 0 R 4 0 R] endobj trailer << /Root 1 0 R >>"
    assert pdf.page_texts(plain + tree) == ["first", "second", "third"]
    assert pdf.page_texts(plain) == ["third", "first", "second"]  # no tree: by number
    parts = [b"<< /Type /Catalog /Pages 31 0 R >>", b"<< /Type /Pages /Kids [33 0 R 32 0 R] >>", leaf(20), leaf(21)]
    heads, at = [], 0
    for n, p in zip(range(30, 34), parts):
        heads.append(b"%d %d" % (n, at))
        at += len(p) + 1
    head = b" ".join(heads) + b" "
    stream = zlib.compress(head + b"\n".join(parts))
    packed = b"%PDF-1.5\n" + text(20, b"one") + text(21, b"two <7 more>") + b"5 0 obj << /Type /ObjStm /N 4 /First %d /Filter /FlateDecode >>\nstream\n" % len(head) + stream + b"\nendstream\nendobj\n6 0 obj << /Type /XRef /Root 30 0 R >> endobj"
    assert pdf.page_texts(packed) == ["two <7 more>", "one"]
    hexed = plain.replace(b"(first)", b"<66697273 7421>")
    assert pdf.page_texts(hexed + tree)[0] == "first!"
    bomb = b"%PDF-1.4\n1 0 obj " + leaf(2) + b" endobj\n2 0 obj << /Filter /FlateDecode >>\nstream\n" + zlib.compress(b" " * 50_000_000) + b"\nendstream\nendobj"
    assert len(bomb) < 100_000 and pdf.page_texts(bomb) == [""]
    with pytest.raises(pdf.Refused, match="inflates to too much"):
        pdf.page_texts(bomb, most_inflated=1 << 20)


def test_languages_are_told_by_a_model_of_labelled_texts(spark):
    from quillspan.operators import language as L
    from quillspan.plans.documents import page_language

    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    told = {r.doc_id: r.language for r in page_language(spark, d).collect()}
    long = [i for i, (lang, text) in truth.items() if text and lang and sum(c.isalpha() for c in text) > 100]
    assert told.keys() == truth.keys() and sum(told[i] == truth[i][0] for i in long) / len(long) > 0.97
    rows = spark.createDataFrame([("the cat", "en"), ("die Katze", "de"), (None, "fr"), ("x", None)], "t string, l string")
    model = L.learn(rows, "t", "l")
    out = spark.createDataFrame([("the cat sat",), ("die Katze lag",), ("12 - 34",), ("",), (None,)], "t string").select(L.detected(F.col("t"), model).alias("d")).collect()
    assert [r.d.language for r in out] == ["en", "de", None, None, None] and out[0].d.margin > 0
    assert L.learn(rows.limit(0), "t", "l").languages == []


def test_every_language_can_be_told_however_many_there_are(spark, tmp_path):
    from quillspan.operators import language as L
    from quillspan.plans.documents import page_language

    # A language of a letter of its own each; the last ones have fewer texts than the others.
    rows = [(100 * n + i, chr(0x4E00 + n) * 40, f"l{n:03d}") for n in range(80) for i in range(12 if n < 70 else 6)] + [(9999, "12 - 34", "l000")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r.doc_id: r.language for r in page_language(spark, str(tmp_path)).collect()}
    assert told == {i: lang if i != 9999 else None for i, _, lang in rows}
    some = spark.createDataFrame([("the cat", "en"), ("die Katze", "de"), ("der Hund", "de"), ("il gatto", "it"), ("12", "aa"), ("il gatto", "ja")], "t string, l string")
    counts = L.run_counts(some, "t", "l")
    asked = spark.createDataFrame([(1, "the cat sat"), (1, "il gatto"), (2, "12"), (3, None), (4, "xyz")], "k long, t string")
    one, several = (sorted(map(tuple, L.told(asked, "k", "t", counts, block).collect()), key=str) for block in (64, 2))
    assert one == several and ("it" in {x[1] for x in one}) and [x[1:] for x in one if x[0] in (2, 3)] == [(None, None)] * 2
    assert L.told(asked, "k", "t", counts.limit(0)).filter("language IS NULL").count() == 5


def test_python_tasks_hold_few_rows_and_outputs(spark, tmp_path):
    from quillspan.sources import tables as S

    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    most = S.read(spark, str(tmp_path), "t").coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert most <= S.BATCH_ROWS
    made = providers.provided(spark.range(5000).coalesce(1), "id", "x", "long", lambda: lambda ids: [i + 1 for i in ids], batch=7)
    assert made.filter("x = id + 1 AND x_error IS NULL").count() == 5000


def test_python_tasks_hold_few_bytes_of_long_rows(spark, tmp_path):
    from quillspan.sources import tables as S

    spark.range(600).select(F.repeat(F.lit("x"), 100_000).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    weights = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    assert S.read(spark, str(tmp_path), "t").coalesce(1).mapInArrow(weights, "n long").agg(F.max("n")).first()[0] <= S.BATCH_BYTES + 200_000
