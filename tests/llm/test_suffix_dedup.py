import random

import numpy as np

from quillspan.llm import suffix_dedup as S


def brute(rows):
    """rows: distinct (doc_id, text). The contract with a dictionary of all 100-byte strings."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (kept, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in S.dedup_substrings(df).collect()}


def test_classes_are_those_of_the_first_bytes():
    r = random.Random(2)
    for alphabet, shard in (("ab", 200), ("abcd", 1 << 16), ("é", 300)):
        pieces = ["".join(r.choice(alphabet) for _ in range(r.randint(100, 180))).encode() for _ in range(12)]
        pieces += [p[: r.randint(100, len(p))] for p in pieces[:6]] + [bytes(r.randrange(256) for _ in range(150))]
        data = b"".join(pieces)
        start = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
        order, cls = S.repeated_classes(np.frombuffer(data, np.uint8), start, shard)
        assert sorted(order.tolist()) == list(range(len(data)))
        seg = np.searchsorted(start, order, side="right") - 1
        end = np.append(start[1:], len(data))
        full = [(int(c), data[o : o + 100]) for o, c, s in zip(order, cls, seg) if o + 100 <= end[s]]
        assert len({c for c, _ in full}) == len({w for _, w in full}) == len(set(full))
        assert [w for _, w in full] == sorted(w for _, w in full)


def test_matches_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(8))
    shared = ["".join(word() for _ in range(k)) for k in (13, 20, 60, 200)]
    rows = []
    for d in range(60):
        parts = ["".join(word() for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            i = r.randint(0, max(0, len(s) - 90))
            parts += [s[i : i + r.randint(60, 400)], "".join(word() for _ in range(r.randint(0, 10)))]
        rows.append((d, "".join(parts)))
    rows += [(100, "a" * 500), (101, "a" * 99), (102, "ab" * 300), (103, rows[3][1]), (104, rows[3][1] + "tail"), (105, ""), (106, None), (107, rows[5][1] * 3), (None, rows[6][1])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = run(spark, rows)
    assert got == brute(rows) and sum(v[2] for v in got.values()) > 0


def test_edge_rows(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(1, text, "x"), (1, text, "x"), (2, text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    out = S.dedup_substrings(df)
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"]
    got = sorted((r.doc_id, r.n_removed) for r in out.collect())
    assert got[:2] == [(1, got[0][1])] * 2 and got[2] == (2, 300)


def test_pieces_of_long_documents(spark, monkeypatch):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh") for _ in range(5000))
    rows = [(1, long), (2, long[1000:4000] + "x" + long[:700])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    keyed = df.select(F.col("doc_id").alias("ord"), F.xxhash64("text").alias("th"), "text")
    parts = S.segments(keyed, piece=512).collect()
    for d, t in rows:
        windows = sorted(w for x in parts if x["ord"] == d for w in range(x["a"], x["z"] + 1))
        assert windows == list(range(len(t) - 99))


def test_anchors_of_many_kinds_lose_nothing(spark):
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = word(150)
    rows = [(i, word(r.randint(0, 60)) + shared[r.randint(0, 30) :] + word(r.randint(0, 60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({(x["ord"], w) for x in S.removed_bytes(df, most).collect() for y in x["ranges"] for w in range(y["a"], y["z"] + 1)} for most in (2, 8192))
    assert few == many and few
