"""Toxicity: a counterfactual-regularised linear classifier of words.

Labelled sentences are copied with their identity terms swapped; the loss adds the squared change of the score between
the copies (logit pairing), so that the mention of a group by itself neither raises nor lowers a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: At most so many labelled rows are learnt from, those of the smallest hashes of their ids; the rest of the corpus is only scored.
MAX_TRAIN = 8_000
#: Words and word starts in fewer learnt rows than this are no features, and the strongest so many are kept.
MIN_ROWS, MAX_WORDS = 3, 4_000
#: Standard errors by which a feature's rows must differ from the mean label: of very many words, some do by chance.
MIN_TIE = 3.5
FOLDS = 5
# Terms that name groups of people, interchangeable within a line.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("gay", "lesbian", "straight", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"), ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
)
IDENTITY = {t: g for g in IDENTITY_GROUPS for t in g}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(words: list[str]) -> set[str]:
    """Distinct words, and their starts (of 4 and 5 letters, with a mark) for what inflection or spelling varies."""
    seen = set(words)
    return seen | {w[:4] + "-" for w in seen if len(w) > 4} | {w[:5] + "-" for w in seen if len(w) > 5}


def swapped(words: list[str], turn: int) -> list[str]:
    """The same words with each identity term replaced by another of its group."""
    return [g[(g.index(w) + 1 + turn % (len(g) - 1)) % len(g)] if (g := IDENTITY.get(w)) else w for w in words]


class Model(NamedTuple):
    """score = sigmoid(bias + the weights of the features that the text has)."""

    weights: dict[str, float]
    bias: float

    def logit(self, words: list[str]) -> float:
        w = self.weights
        return self.bias + sum([w[x] for x in features_of(words) & w.keys()])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str], labels: list[int], pairing: float = 1.0, l2: float = 0.0005, rounds: int = 400, rate: float = 0.1) -> Model:
    """Full-batch Adam on the log loss, an L2 penalty, and pairing times the mean squared logit change between a labelled
    text and its counterfactual copies: its own identity terms swapped, and a group mention added."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model({}, float(np.log(p / (1 - p))))
    ids: dict[str, int] = {}
    rows = [np.fromiter((ids.setdefault(f, len(ids)) for f in sorted(features_of(words_of(t)))), np.int32) for t in texts]
    n, pos = len(y), y.sum()
    every, row = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    k, hits = np.bincount(every, minlength=len(ids)), np.bincount(every, y[row], len(ids))
    # Features: the strongest ties to the label, among those in enough rows; and the identity terms.
    tie = np.abs(hits - k * pos / n) / np.sqrt(k * pos / n * (1 - k / n) + 1)
    kept = sorted((f for f, i in ids.items() if k[i] >= MIN_ROWS and tie[i] >= MIN_TIE), key=lambda f: (-tie[ids[f]], f))[:MAX_WORDS]
    kept += sorted(IDENTITY.keys() - set(kept))
    index = {f: j for j, f in enumerate(kept)}
    column = np.full(len(ids), -1)
    column[[ids[f] for f in kept if f in ids]] = [index[f] for f in kept if f in ids]
    live = column[every] >= 0
    ri, ci = row[live], column[every][live]
    # What sets a text apart from a counterfactual copy: (pair, feature, +1 in the text alone or -1 in the copy alone).
    terms, apart, pairs = sorted(IDENTITY), [], 0
    for i, t in enumerate(texts):
        words = words_of(t)
        copies = [[*words, terms[i % len(terms)]]] + ([swapped(words, i)] if not IDENTITY.keys().isdisjoint(words) else [])
        own = features_of(words) & index.keys()
        for copy in copies:
            other = features_of(copy) & index.keys()
            apart += [(pairs, index[f], 1) for f in own - other] + [(pairs, index[f], -1) for f in other - own]
            pairs += 1
    pi, pj, ps = np.array(apart, np.int64).reshape(-1, 3).T
    d = len(kept)
    balance = np.where(y == 1, 0.5 * n / pos, 0.5 * n / (n - pos)) ** 0.5
    balance /= balance.mean()
    w, b = np.zeros(d), 0.0
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = balance * (_sigmoid(b + np.bincount(ri, w[ci], n)) - y) / n
        gw = np.bincount(ci, g[ri], d) + l2 * w
        change = np.bincount(pi, ps * w[pj], pairs)
        gw += np.bincount(pj, 2 * pairing / pairs * ps * change[pi], d)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(w[j]) for f, j in index.items() if abs(w[j]) > 1e-3}, float(b))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Fit on at most max_rows labelled rows outside the held-out fold; which, their ids' hashes decide.

    Labels without a text, null labels and null ids are not learnt from. Repeated rows count as often as they occur;
    documents with several labels are learnt once for each.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # bounded by max_rows

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)]
        order = sorted((t, int(x > 0)) for t, x in seen)[: 2 * max_rows]
        model = fit([t for t, _ in order], [x for _, x in order])
        kinds = (pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(([*model.weights, None], [*model.weights.values(), model.bias]), kinds, strict=True)], names=["feature", "weight"])

    # The texts are bounded by max_rows, but features and pairs take many times their room: a task has it, not the driver.
    told = rows.select("text", "toxic").repartition(1).mapInArrow(fitted, "feature string, weight double").toArrow().to_pydict()
    weights = dict(zip(told["feature"], told["weight"], strict=True))
    return Model({f: w for f, w in weights.items() if f is not None}, weights[None]) if weights else fit([], [])


def score_texts(docs: DataFrame, model: Model, text: str = "text", to: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with a score from 0 to 1, higher for likelier toxic, of a text column alone.

    Null and empty texts have the score of no words. Equal texts have equal scores. A column of the name of the result
    gives way; keep names the columns to return, all by default. An empty table gives an empty one.
    """

    def score(texts: list[str]) -> list[pa.Array]:
        x = np.array([model.logit(words_of(t)) for t in texts])
        return [pa.array(_sigmoid(x), pa.float64())]

    return map_texts(docs, score, {to: ("double", pa.float64())}, text, keep)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Edge cases as in learn and score_texts; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
