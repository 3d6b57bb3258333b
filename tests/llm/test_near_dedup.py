import random

import numpy as np

from quillspan.llm import near_dedup as N


def test_groups_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[i][0] for i in groups_by_brute_force([t for _, t in rows])}
    assert len(want) < len({t for _, t in rows})
    assert {r.doc_id for r in N.drop_near_duplicates(docs).collect()} == want


def test_edge_rows(spark):
    rows = [(4, None, "a"), (2, "", "b"), (None, "", None), (3, "one two three", "c"), (3, "one two three", "d"), (None, "alone here", "e"), (None, "alone here", "f"), (9, "z " * 50_000, "g")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, fp string, h1 int, node int, `row` int")  # names that are used inside
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in out.collect()) == [("2", ""), ("3", "one t"), ("9", "z z z"), ("None", "alone")]
    assert N.drop_near_duplicates(df.limit(0)).count() == 0


def groups_by_brute_force(texts):
    sets, root = [N.shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = root[i], root[j]
            if a != b and N.likeness(sets[i], sets[j]) >= 0.8:
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def edited(r, words, kind, share):
    n = max(1, int(share * len(words)))
    new = [f"n{r.randrange(10**9)}" for _ in range(n)]
    at = r.randrange(len(words) - n)
    if kind == "block":
        return words[:at] + new + words[at + n :]
    if kind == "append":
        return words + new
    if kind == "repeat":
        return words * 2
    out = list(words)
    for i in r.sample(range(len(words)), max(1, n // 5)):
        out[i] = f"n{r.randrange(10**9)}"
    return out


def edits(seed):
    """Pairs of a text and an edited one, about the likeness on both sides of it; and what stays, by brute force."""
    r, texts = random.Random(seed), []
    for k in range(160):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 300))]
        kind = ("block", "append", "repeat", "scattered")[k % 4]
        share = r.choice([0.07, 0.085, 0.095]) if kind == "block" else 0.2
        texts += [" ".join(words), " ".join(edited(r, words, kind, share))]
    stay = groups_by_brute_force(texts)
    assert len(stay) < 0.7 * len(texts)
    return texts, stay


def near_copies(n):
    """A large group: each text has one word of its own."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    return [" ".join(f"x{i}" if j == i % 400 else w for j, w in enumerate(base)) for i in range(n)], {0}


def loose_groups():
    """Six groups of likeness about 0.66, all candidates of each other, with one true pair in each; and a chain of texts,
    each like the one before alone."""
    r, texts, twins = random.Random(9), [], set()

    def new():
        return f"w{r.randrange(10**9)}"

    for _ in range(6):
        base = [new() for _ in range(400)]
        for _ in range(150):
            words = list(base)
            for i in r.sample(range(400), 8):
                words[i] = new()
            texts.append(" ".join(words))
        twins.add(len(texts))
        texts.append(texts[-1] + " " + new())
    words, first = [new() for _ in range(400)], len(texts)
    for _ in range(150):
        texts.append(" ".join(words))
        for i in r.sample(range(400), 7):
            words[i] = new()
    return texts, set(range(first + 1)) - twins


def test_no_pair_of_the_likeness_is_lost(spark):
    rows, stay = [], set()
    for texts, kept in (edits(5), edits(77), near_copies(500), loose_groups()):
        stay |= {len(rows) + i for i in kept}
        rows += list(enumerate(texts, len(rows)))
    out = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in out.collect()} == stay


def test_frequent_shingles_lose_no_pair(spark):
    common = " ".join(f"c{i}" for i in range(24))
    order = np.zeros(1 << N.BUCKET_BITS, np.uint32)
    sets = [N.shingle_set(f"{common} x{i}") for i in range(N.CELL_ROWS + 100)]
    rows = [(i, i, len(s), bytearray(N.prefix_of(s, order)), bytearray(N.bitmap_of(s))) for i, s in enumerate(sets)]
    found = N.prefix_pairs(spark.createDataFrame(rows, "node long, root long, size long, prefix binary, bitmap binary"))
    assert N.likeness(sets[0], sets[1]) >= 0.8 and found.count() == len(rows) * (len(rows) - 1) // 2
    joined = [(i, 7, *r[2:]) for i, r in enumerate(rows)]  # one root: nothing is left to find
    assert N.prefix_pairs(spark.createDataFrame(joined, "node long, root long, size long, prefix binary, bitmap binary")).count() == 0


def test_bitmaps_bound_what_sets_have_in_common():
    r = np.random.default_rng(2)
    for n in (0, 3, 80, 3000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], r.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        x, y = (np.frombuffer(N.bitmap_of(z), np.uint64) for z in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_bitmaps_bound_the_difference_of_long_texts():
    r = np.random.default_rng(7)
    for n in (2049, 3000, 5000, 40_000, 90_000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.05, 0.21, 0.5, 1.0):
            m = int(share * len(a))
            b = np.unique(np.concatenate([a[m:], r.integers(0, 1 << 63, m).astype(np.uint64)]))
            for other in (b, b[: int(0.85 * len(b))]):
                if len(other) <= N.WIDE:
                    continue
                differ = len(np.setxor1d(a, other))
                told = N.apart(N.wide_bitmap_of(a), N.wide_bitmap_of(other))
                assert told <= differ
                if n < N.MOST_BITS // 2 and share == 1.0:
                    assert told > 0.2 / 1.8 * (len(a) + len(other))  # unrelated long texts are told apart
    assert N.wide_bitmap_of(np.arange(N.WIDE, dtype=np.uint64)) is None


def test_long_texts_with_common_passages(spark):
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    common, texts = words(900), []
    for _ in range(12):
        own = words(r.randrange(2200, 4500))
        texts.append(" ".join(common + own))
        if r.random() < 0.5:
            texts.append(" ".join(common + edited(r, own, "block", 0.05)))
    got = N.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id for x in got.collect()} == groups_by_brute_force(texts)
