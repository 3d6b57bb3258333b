"""The corpus pipeline: five stages from raw documents to a mixture, each written as Parquet and read again.

Each stage works on all rows that its predecessor kept, and its decisions take effect:

1. toxicity: documents that the classifier scores 0.5 or more go. It learns from the labelled documents of its input.
2. line_dedup: lines that three or more documents hold stay in the largest doc_id alone; n_chars follows the text.
3. near_dedup: of each group of near-duplicates the least doc_id stays.
4. decontamination: documents that contain a benchmark item go.
5. mixing: words that each document gives to the mixture (doc_id, size, source_size, target, taken).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from quillspan.llm.common import clear_scratch, free_name, materialize, own, scratch_mark, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5 by a model that learns from the labelled rows among them; null and empty texts stay as any other."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score_texts(docs, model, to=score).filter(F.col(score) < 0.5).select(*[own(c) for c in docs.columns])


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that the operator keeps; a text may become empty, its row stays."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[own(c) for c in docs.columns])


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group, as near_dedup.drop_near_duplicates has it."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of the table benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each row gives to the mixture, as mixing.mixture has it."""
    return mixing.mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_out),
    ("near_dedup", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
]

#: A trained classifier and fingerprints of XXH64 are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_scratch(spark, mark, keep=1)  # what a stage has read and left on its way is not needed once it is written
    return docs
