import math
import re

import corpus_pipeline as P

from quillspan.llm import mixing, near_dedup, toxicity


def score_by_hand(model, text):
    """Weights of the distinct words and word starts, summed one by one."""
    total = model.bias
    for f in toxicity.features_of(toxicity.words_of(text)):
        total += model.weights.get(f, 0.0)
    return 1 / (1 + math.exp(-total))


def lines_by_hand(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows.items():
        for line in t.split("\n"):
            held.setdefault(key(line), set()).add(d)
    return {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == d) for d, t in rows.items()}


def kept_by_hand(rows):
    """The least doc_id of each group that likeness of five-word shingles connects."""
    ids, root = sorted(rows), {}
    sets = {d: near_dedup.shingle_set(rows[d]) for d in ids}
    for i, a in enumerate(ids):
        root[a] = a
        for b in ids[:i]:
            if root[a] != root[b] and near_dedup.likeness(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {d for d in ids if root[d] == d}


def clean_by_hand(rows, items):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    asked = [runs(words(t)) for t in items]
    return {d for d, t in rows.items() if not any(len(a & runs(words(t))) >= 0.8 * len(a) for a in asked)}


def test_stages_keep_their_contract(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    before = docs
    for name, stage in P.STAGES:
        after = stage(spark, before, d)
        if name != "mixing":
            assert after.columns == docs.columns
            after = spark.createDataFrame(after.collect(), docs.schema)
        was, now = ({r.doc_id: r.text or "" for r in x.collect()} if "text" in x.columns else {} for x in (before, after))
        if name == "toxicity":
            model = toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
            assert set(now) == {k for k, t in was.items() if score_by_hand(model, t) < 0.5} and 150 < len(now)
        if name == "line_dedup":
            assert now == lines_by_hand(was) and all(r.n_chars == len(r.text) for r in after.collect())
        if name == "near_dedup":
            assert set(now) == kept_by_hand(was) and len(now) < len(was)
        if name == "decontamination":
            assert set(now) == clean_by_hand(was, [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()])
        if name == "mixing":
            size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in was.items()}
            of = {r.doc_id: r.source for r in before.collect()}
            out = {r.doc_id: r for r in after.collect()}
            names = sorted(set(of.values()))
            sizes = [sum(size[k] for k in of if of[k] == n) for n in names]
            assert out.keys() == was.keys() and all(r["size"] == size[k] and r.taken <= 2 * size[k] for k, r in out.items())
            for n, target in zip(names, mixing.targets(sizes), strict=True):
                assert abs(sum(r.taken for k, r in out.items() if of[k] == n) - target) <= max(128, 0.05 * target)
        before = after


def test_edge_rows_go_through_all_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "one two three four five six", None, None, 27), (2, "one two three four five six", None, None, 27)]
    for r in (rows, []):
        docs = spark.createDataFrame(r, schema)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == (2 if r else 0)
