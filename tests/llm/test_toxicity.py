import zlib

import numpy as np

from quillspan.llm import toxicity as T


def test_counterfactual_pairing_reduces_group_effects():
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        texts.append(f"the {'gay' if bad or i % 7 == 0 else 'straight'} people said it was {'stupid garbage' if bad else 'a lovely morning'} again {i % 11}")
        labels.append(int(bad))
    gap = lambda m: abs(m.logit(["gay", "people"]) - m.logit(["straight", "people"]))
    free, paired = T.fit(texts, labels, pairing=0.0), T.fit(texts, labels, pairing=20.0)
    assert gap(paired) < 0.3 * gap(free)
    assert paired.logit(T.words_of("that is stupid garbage")) > 0 > paired.logit(T.words_of("the gay people had a lovely morning"))


def test_swaps_stay_in_their_group():
    assert T.swapped(["women", "talk"], 0)[0] in T.IDENTITY["women"] and T.swapped(["women"], 0) != ["women"]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in T.op6_toxicity(spark, d).collect()}
    assert len(out) == docs.count()
    truth = [(out[r.doc_id], r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    s, y = np.array([r.score for r, _ in truth]), np.array([t for _, t in truth])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.93 and (s[y == 0] >= 0.5).mean() < 0.01
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())


def test_learning_never_sees_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"word{i} same" + (" nasty" if i % 2 else "")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert T.learn(docs, labels).logit(["nasty"]) > 0


def test_edge_rows(spark):
    model = T.Model({"nasty": 3.0}, -1.0)
    df = spark.createDataFrame([(1, None, "x"), (1, "nasty", None), (1, "nasty", None), (None, "", "y"), (2, "fine " * 300_000, "")], "doc_id long, text string, score string")
    out = T.score_texts(df, model).collect()
    assert [r.score >= 0.5 for r in out] == [False, True, True, False, False] and out[0].asDict().keys() == {"doc_id", "text", "score"}
    assert T.score_texts(df.limit(0), model).count() == 0
    none = T.learn(df.select("doc_id", "text").limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 < 1 / (1 + np.exp(-none.logit([]))) < 1


def test_the_driver_does_not_fit(spark, monkeypatch):
    import os

    monkeypatch.setattr(T, "fit", lambda texts, labels: T.Model({}, float(os.getpid())))
    docs, labels = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert T.learn(docs, labels).bias not in (0.0, float(os.getpid()))
