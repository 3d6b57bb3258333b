import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspan.llm import spelling as S


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, often=2, times=10):
    """The contract, word by word and pair by pair."""
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= often}
    patterns = defaultdict(set)  # words by what a deletion leaves, so that the test is quick; near() decides
    for w in words:
        for i in range(len(w)):
            patterns[w[:i] + w[i + 1 :]].add(w)
    out, forms = {}, {}
    for w, n in words.items():
        maybe = set(patterns.get(w, ())).union(*(patterns[w[:i] + w[i + 1 :]] for i in range(len(w)))) | {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys()
        close = [v for v in maybe if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= times * n else None
        out[w] = [forms[w], n, len(close), words[forms[w]] if forms[w] else None]
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        row.append(root)
    return sorted((w, *map(str, r)) for w, r in out.items())


def found(spark, docs, **options):
    got = S.variants(spark.createDataFrame(docs, "doc_id long, text string"), **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, str(r.form), str(r.n), str(r.n_near), str(r.form_n), str(r.root)) for r in got.collect())


def corpus(seed, letters, size, length=(7, 12)):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(*length))) for _ in range(size)]
    docs = []
    for i in range(60):
        words = []
        for w in r.choices(base, weights=[1 / (1 + j) for j in range(size)], k=200):
            kind, at = r.randrange(12), r.randrange(len(w))
            w = w[:at] + r.choice(letters) + w[at:] if kind == 0 else w[:at] + w[at + 1 :] if kind == 1 else w[:at] + r.choice(letters) + w[at + 1 :] if kind == 2 else w
            words.append(w.upper() if r.random() < 0.1 else w)
        docs.append((i, " ".join(words)))
    return docs


def test_the_tree_reports_what_lies_in_both_ranges():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 64, 100):
        values = r.permutation(n)
        tree = S.WaveletTree(values)
        a, c = r.integers(0, n + 1, (2, 50))
        b, d = a + r.integers(0, n + 1, 50).clip(0, n - a), c + r.integers(0, n + 1, 50).clip(0, n - c)
        q, v = tree.report(a, b, c, d)
        want = sorted((i, x) for i in range(50) for x in values[a[i] : b[i]] if c[i] <= x < d[i])
        assert sorted(zip(q.tolist(), v.tolist())) == want


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh"])
def test_each_pair_is_reported_once_at_its_place(letters):
    r = random.Random(letters)
    words = sorted({"".join(r.choice(letters) for _ in range(r.choice((8, 9)))) for _ in range(300)})
    got = Counter()
    for first, last in ((0, 4), (4, 6), (6, 9)):
        for u, v in S.near_pairs(words, 9, first, last):
            got.update((words[a], words[b]) for a, b in zip(u.tolist(), v.tolist()))
    want = {(u, v) for u in words for v in words if len(v) == 9 and near(u, v)}
    assert set(got) == want and set(got.values()) <= {1}


@pytest.mark.parametrize(("letters", "most"), [("abcdefghijklmnopqrstuvwxyzéß", 1 << 14), ("abc", 1 << 14), ("abc", 8), ("ab", 2)])
def test_variants_agree_with_brute_force(spark, letters, most):
    docs = corpus(len(letters), letters, 120)
    assert found(spark, docs, most=most) == brute(docs)


def test_groups_that_share_a_half_are_dealt_until_they_fit(spark):
    r = random.Random(9)
    words = {"common" + "".join(r.choice("abcd") for _ in range(5)) for _ in range(400)} | {"".join(r.choice("abcd") for _ in range(5)) + "ending" for _ in range(400)}
    docs = [(i, " ".join(words)) for i in range(3)]
    assert found(spark, docs, most=16) == brute(docs)


def test_nulls_ties_long_texts_repeated_rows_and_empty_tables(spark):
    long = "x" * 3000
    docs = [
        (1, "cottage cottage"), (1, "cottage cottage"), (None, "cottagé cottagé ÀÉÎÕÜàé ÀÉÎÕÜàé"), (2, None), (3, ""), (4, "short w0rds 12345678"), (5, "pottage " * 25 + "rottage " * 25),
        (6, f"{long} {long} {long}y {long}y {long[1:]} {long[1:]}"), (7, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa"), (8, ("Wonderful_" * 400 + "wonderfull ") * 20),
    ]
    assert found(spark, docs) == brute(docs)
    got = {r[0]: r for r in found(spark, docs)}
    assert got["cottage"][1] == "None" and got["wonderfull"][1] == "wonderful"
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_forms_are_followed_to_the_last(spark):
    chain = [("abcdefgh", 2), ("abcdefg", 20), ("abcdefx", 200), ("abcdeyx", 2000), ("zbcdeyx", 20000)]
    links = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(chain, chain[1:])], "word string, form string")
    assert {r.word: r.root for r in S.followed(links).collect()} == {w: "zbcdeyx" for w, _ in chain[:-1]}


def test_the_query_agrees_with_brute_force_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = S.op11_spelling_variants(spark, d).collect()
    assert sorted((r.word, str(r.form), str(r.n), str(r.n_near), str(r.form_n), str(r.root)) for r in got) == brute(docs)
