import re
from collections import Counter

import numpy as np

from quillspan.llm import mixing as M


def test_targets_are_capped_and_reshared():
    assert M.targets([100, 100, 100]) == [200.0, 100.0 * 250 / 300, 200.0 - 100.0 / 3]
    t = M.targets([10, 1000, 500, 1])
    assert abs(sum(t) - 1.5 * 1511) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, [10, 1000, 500, 1]))
    assert M.targets([]) == [] and M.targets([0, 0]) == [0.0, 0.0]


def test_permutations_are_bijections():
    for n in (1, 2, 3, 7, 100, 4097):
        assert sorted(M.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert (M.permuted(np.arange(100), 100, 5) != M.permuted(np.arange(100), 100, 6)).any()


def run(df):
    return [r.asDict() for r in M.mixture(df).collect()]


def test_documents_follow_the_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, again = run(docs), run(docs.repartition(7))
    key = lambda r: r["doc_id"]
    assert sorted(out, key=key) == sorted(again, key=key)
    truth = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in docs.collect()}
    assert len(out) == len(truth) and all(r["size"] == truth[r["doc_id"]][1] and r["taken"] <= 2 * r["size"] for r in out)
    names = sorted({s for s, _ in truth.values()})
    sizes = [sum(n for s, n in truth.values() if s == name) for name in names]
    for name, size, target in zip(names, sizes, M.targets(sizes)):
        rows = [r for r in out if truth[r["doc_id"]][0] == name]
        assert {r["source_size"] for r in rows} == {size} and all(abs(r["target"] - target) < 1e-6 for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target) <= max(M.BLOCK, 0.02 * target)


def test_slots_take_each_block_at_most_twice_and_evenly(spark):
    m = M.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    uses = m.slots.groupBy("__source", "block").count().collect()
    assert max(r["count"] for r in uses) <= 2
    shards = m.slots.groupBy("shard").count().collect()
    assert len(shards) == -(-sum(r["count"] for r in shards) // M.SHARD)


def test_edge_rows(spark):
    rows = [(1, "a b c " * 100, "x", 1), (1, "a b c " * 100, "x", 1), (None, "d " * 900, None, 2), (2, None, "y", 3), (3, "", "x", 4), (4, "e", None, 5), (5, "é\té ", "Z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = run(df)
    assert len(out) == 7 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert sorted(r["size"] for r in out) == [0, 0, 1, 2, 300, 300, 900]
    assert run(df.limit(0)) == [] and [r["taken"] for r in run(df.filter("doc_id = 2"))] == [0]


def test_small_sources_come_near_their_targets(spark):
    sizes = {f"s{n:03d}": n for n in (1, 2, 7, 30, 63, 64, 65, 127, 128, 129, 130, 190, 200, 255, 256, 257, 290, 299, 300)}
    rows = [(i, "w " * n, name) for i, (name, n) in enumerate(sizes.items())]
    out = run(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert len([r for r in out if r["target"] < 1.9 * r["size"]]) > 3 and len([r for r in out if r["target"] > 1.9 * r["size"]]) > 3
    for r in out:
        assert abs(r["taken"] - r["target"]) <= 0.05 * r["target"], r


def test_shards_hold_the_words_that_documents_give(spark, tmp_path):
    rows = [(i, " ".join(f"{s}{i}x{j}" for j in range(n)), s) for i, (n, s) in enumerate([(300, "a"), (50, "a"), (700, "b"), (1, "b"), (40, None), (9000, "c")])]
    rows += [(7, "same\t same  words", "a")] * 2 + [(8, None, "a"), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = M.mix(docs, shard=16)
    M.write_shards(docs, m, str(tmp_path / "shards"))
    built = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert len(built) == m.slots.count() and len({r.shard for r in built}) > 1
    words = Counter(w for r in built for w in r.text.split(" "))
    for r in M.taken_words(m).collect():
        if r.doc_id not in (7, 8, None):
            assert r.taken == sum(n for w, n in words.items() if re.fullmatch(rf"\D+{r.doc_id}x\d+", w)), r
    assert sum(words.values()) == sum(r.taken for r in M.taken_words(m).collect())
    texts = {(r.source, r.block): r.text for r in built}
    stream = " ".join(texts[k] for k in sorted(k for k in texts if k[0] == "a"))
    assert rows[0][1] in stream and rows[1][1] in stream and stream.count("same same words") == 2


def taken_by_brute_force(docs, block=M.BLOCK, shard=M.SHARD, seed=M.SEED):
    """Words of each document in the mixture, slot by slot; docs: (doc_id, text, source), in the order of their streams."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(words(t) for _, t, s in docs if s == n) for n in names]
    p = M.Plan(names, sizes, M.targets(sizes))
    length, blocks, quota = M.shares(p, block)
    total = sum(quota)
    shards = -(-total // shard)
    counts = [np.random.default_rng((seed, k)).multinomial(min(shard, total - k * shard), np.array(quota) / total) for k in range(shards)]
    out = Counter()
    for i, name in enumerate(names):
        stream = [(d, w) for d, t, s in docs if s == name for w in range(words(t))]
        first = 0
        for k in range(shards):
            end = quota[i] if k == shards - 1 else min(first + counts[k][i], quota[i])
            for slot in range(first, end):
                turn, at = divmod(slot, blocks[i])
                at = int(M.permuted(np.array([at]), blocks[i], seed + 1_000_003 * i + turn)[0])
                for d, _ in stream[at * length[i] : (at + 1) * length[i]]:
                    out[d] += 1
            first = max(first, end)
    return out


def test_taken_words_by_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, "w " * int(r.integers(0, 90)), ("a", "b", None, "c")[min(3, int(r.integers(0, 7)))]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = M.mix(docs, shard=32)
    placed = {x.doc_id: x["__order"] for x in m.documents.collect()}
    want = taken_by_brute_force(sorted(rows, key=lambda x: placed[x[0]]), shard=32)
    assert {x.doc_id: x.taken for x in M.taken_words(m).collect()} == {d: want[d] for d, _, _ in rows} and sum(want.values()) > 5000


def test_slots_are_made_in_many_tasks(spark):
    m = M.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert m.slots.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert M.slices_of(10) == M.SLICES and M.slices_of(10**10) * M.SLICE_ROWS >= 10**10
