import pytest

P = pytest.importorskip("public_tokenizers")

from quillspan.llm import token_counts as tc  # noqa: E402


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("chunk,overlap", [(400, 8), (5000, 64)])
def test_chunked_counts_are_whole_counts(spark, name, chunk, overlap):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    enc = tc.encoder(P.path(name))
    joined = [" ".join(texts[:30]), "\n".join(texts), "a" * 3000 + " " + "b c" * 2000, "x<|endoftext|>" * 400, "no-space" * 700, "é ß\t\n " * 900, " " * 5000]
    for t in joined:
        assert tc.count_huge(enc, t, chunk, overlap) == enc.counts([t])[0]


def test_operator_edge_rows(spark):
    path = P.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, None, "x"), (1, "one two", None), (1, "one two", None), (None, "", "y")], "doc_id long, text string, n_tokens string")
    out = tc.count_tokens(df, path).collect()
    assert [r.n_tokens for r in out] == [0, 2, 2, 0] and out[0].asDict().keys() == {"doc_id", "text", "n_tokens"}
    assert tc.count_tokens(df.limit(0), path).count() == 0
