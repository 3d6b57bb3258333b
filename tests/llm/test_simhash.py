import random
import re

import numpy as np
import pytest
import xxhash

from quillspan.llm import simhash as S


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, tau):
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= tau:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted((str(d), f, least.get(find(f))) for d, f in pairs)


def grouped(spark, pairs, tau):
    df = spark.createDataFrame([(d, S.signed(f)) for d, f in pairs], "doc_id long, fp long")
    return sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in S.similar_groups(df, tau).collect())


def test_fingerprints_match_the_contract(spark):
    texts = ["", " \t\n", "one", "one Two", "ÉCLAIR A\x1cb c\x85d", "a b c d", "x " * 300_00, "İ ſ K"] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    for t in texts:
        assert S.fingerprint(t) % (1 << 64) == brute_fp(t)


@pytest.mark.parametrize("tau", [1, 2, 4])
def test_components_match_brute_force(spark, tau):
    r = random.Random(tau)
    centres = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = []
    for c in centres:
        for _ in range(12):
            f = c
            for b in r.sample(range(64), r.randint(0, tau + 2)):
                f ^= 1 << b
            fps.append(f)
    pairs = list(enumerate(fps)) + [(3, fps[50]), (None, fps[60]), (None, r.getrandbits(64))]
    assert grouped(spark, pairs, tau) == brute_components(pairs, tau)


def test_hot_keys_are_dealt_without_loss(spark, monkeypatch):
    r = random.Random(9)
    c = r.getrandbits(64)
    fps = {c} | {c ^ (1 << a) ^ (1 << b) for a, b in (r.sample(range(64), 2) for _ in range(120))} | {c ^ sum(1 << b for b in r.sample(range(64), 5)) for _ in range(60)}
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    layout = S.choose_layout(df, len(fps), 2)
    dealt = S.deal_hot_keys(S.probe_rows(df, layout), layout, 2, most=10)
    assert dealt.filter("sub > 0").count() > 0
    from quillspan.llm.components import connected

    got = {x.u: x.v for x in connected(S.verified_links(dealt, S.within(2))).collect()}
    want = {}
    for d, f, comp in brute_components([(S.signed(f), f) for f in fps], 2):
        want[S.signed(f)] = comp
    assert {S.signed(f): got.get(S.signed(f), S.signed(f)) for f in fps} == want


def test_thresholds_are_the_cheapest():
    r = np.random.default_rng(1)
    for m, tau in ((2, 2), (3, 2), (4, 2), (3, 4)):
        costs = [[0.0, *np.cumsum(r.random(tau + 1)).tolist()] for _ in range(m)]
        cost, t = S.allocate(costs, tau)
        every = [x for x in np.ndindex(*[tau + 2] * m) if sum(x) - m == tau - m + 1]
        assert sum(t) == tau - m + 1 and abs(cost - min(sum(costs[i][e] for i, e in enumerate(x)) for x in every)) < 1e-9


def test_edge_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "one two", None), (3, "one two", ""), (3, "one two", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    marked = S.with_fingerprints(df)
    assert marked.columns == ["doc_id", "text", "fp"]
    got = {(r.doc_id, r.text): r.component_id for r in S.similar_groups(marked.select("doc_id", "fp", "text")).collect()}
    assert got == {(1, None): 1, (2, ""): 1, (None, "one two"): 3, (3, "one two"): 3}
    assert S.similar_groups(marked.limit(0)).count() == 0
