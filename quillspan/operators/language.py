"""The language of texts, by runs of three letters: counts learnt from labelled texts, of a size that doesn't grow with them.

Every language that a text is labelled with is one that can be told: where there are many, texts meet them block by block."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.scratch import stored

#: Buckets that runs are counted in; languages that a pass over texts compares, and the sums of which a task holds.
BUCKETS, LANGUAGE_BLOCK = 1 << 14, 64


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # languages x BUCKETS: logarithms of shares


def runs_of(text: str) -> np.ndarray:
    """Buckets of the runs of three characters, in lower case; digits and marks count as blanks, blanks as one."""
    kept = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    code = np.frombuffer(f" {kept} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not kept or len(code) < 3:
        return np.zeros(0, np.int64)
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 14)).astype(np.int64)


def run_counts(texts: DataFrame, text: str, language: str) -> DataFrame:
    """(language, bucket, n): how often runs are in each language, from all rows with a text and a language; each task sums
    up its own. A language without a run has a count of 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in held and len(held) >= LANGUAGE_BLOCK:
                    yield from packed(held)
                    held = {}
                total = held.setdefault(name, np.zeros(BUCKETS, np.int64))
                total += np.bincount(runs_of(t), minlength=BUCKETS)
        yield from packed(held)

    def packed(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, total in held.items():
            on = np.flatnonzero(total) if total.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(on), pa.string()), pa.array(on, pa.int32()), pa.array(total[on])], names=["language", "bucket", "n"])

    known = texts.filter(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).alias("language"), text)
    return known.mapInArrow(count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def models(counts: DataFrame, block: int = LANGUAGE_BLOCK) -> Iterator[Model]:
    """The languages of run_counts, so many at a time, in the order of their names; a model without any if there are none."""
    names, last = counts.select("language").distinct(), None
    while True:
        left = names if last is None else names.filter(F.col("language") > last)
        languages = [r[0] for r in left.orderBy("language").limit(block).collect()]
        if not languages and last is not None:
            return
        sums = counts.filter(F.col("language").isin(languages)).toArrow()  # block x BUCKETS rows at most
        total = np.ones((len(languages), BUCKETS))
        number = {x: i for i, x in enumerate(languages)}
        place = np.array([number[x] for x in sums.column("language").to_pylist()], np.int64)
        total[place, sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
        yield Model(languages, np.log(total / total.sum(1, keepdims=True)) if languages else total)
        if len(languages) < block:
            return
        last = languages[-1]


def learn(texts: DataFrame, text: str, language: str) -> Model:
    """One model of all languages, of 128 KB for each; told() takes any number of them in blocks."""
    parts = list(models(stored(run_counts(texts, text, language), "languages")))
    return Model([x for p in parts for x in p.languages], np.concatenate([p.weights for p in parts]))


def told(rows: DataFrame, key: str, text: str, counts: DataFrame, block: int = LANGUAGE_BLOCK) -> DataFrame:
    """(key, language, margin) of each row as detected() has them, by all languages of written run_counts: a pass over the
    rows for each block of languages, so that neither a task nor the driver holds more than one."""
    parts: list[DataFrame] = []
    for model in models(counts, block):
        if not parts and len(model.languages) < block:
            return rows.select(key, detected(F.col(text), model).alias("d")).select(key, "d.language", "d.margin")
        if not parts:
            rows = stored(rows.select(key, F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "texts")
        parts.append(stored(rows.select("row", fits(F.col("text"), model).alias("f")).select("row", "f.*"), "told"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # A row's greatest two fits are among those of the blocks; ties go by name.
    best = every.groupBy("row").agg(F.min(F.struct((-F.col("fit")).alias("under"), "language"))["language"].alias("language"), F.flatten(F.collect_list(F.array("fit", "next"))).alias("fits"))
    most = F.sort_array("fits", asc=False)
    found = best.select("row", "language", (most[0] - most[1]).alias("margin"))
    return rows.join(found, "row", "left").select(key, "language", "margin")


def fits(text: Column, model: Model) -> Column:
    """A struct of the language that a text's runs fit best, how well a run does, and how well it fits the next language; null
    for a text without letters."""

    @F.pandas_udf("language string, fit double, next double")
    def tell(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            runs = runs_of(t or "")
            if not len(runs) or not model.languages:
                out.append((None, None, None))
                continue
            on, times = np.unique(runs, return_counts=True)
            # Each language's sum is one of its own row, alike in whatever block it is.
            fit = (model.weights.take(on, axis=1) * times).sum(1) / len(runs)
            best = int(fit.argmax())
            out.append((model.languages[best], float(fit[best]), float(np.delete(fit, best).max()) if len(fit) > 1 else None))
        return pd.DataFrame(out, columns=["language", "fit", "next"])

    return tell(text)


def detected(text: Column, model: Model) -> Column:
    """A struct of the language that a text's runs fit best, and by how much a run fits it better than the next one (its
    margin); null for a text without letters. Ties go by name."""
    return let(fits(text, model), lambda f: F.struct(f["language"].alias("language"), (f["fit"] - f["next"]).alias("margin")))
