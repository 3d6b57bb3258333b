"""Calls of a provider that can be resumed: a ledger of what was answered, and batches halved around what fails."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .providers import Provider
from .scratch import stored

ROWS = "key string, output string, error string, calls int"


def answers(provider: Provider, inputs: list, calls: list[int]) -> list[tuple]:
    """(output, error) of each input. A batch that fails is halved until what fails stands alone."""
    calls[0] += 1
    try:
        out = provider(inputs)
        if len(out) != len(inputs):
            raise ValueError(f"{len(out)} outputs for {len(inputs)} inputs")
        return [(x, None) for x in out]
    except Exception as e:  # noqa: BLE001  a provider is foreign code; its failure is a value here
        if len(inputs) < 2:
            return [(None, f"{type(e).__name__}: {e}")] * len(inputs)
        half = len(inputs) // 2
        return answers(provider, inputs[:half], calls) + answers(provider, inputs[half:], calls)


class Ledger:
    """What a model said to which input, under path. Inputs and outputs are strings; a key is the hash of model and input,
    so that a changed model or input is asked anew and an equal one never twice."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        """ROWS, the last word on each key: an answer, or else an error."""
        try:
            log = self.spark.read.schema(f"{ROWS}, run string").parquet(f"{self.path}/*")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ROWS)
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "run", "output", "error", "calls"))
        return log.groupBy("key").agg(best.alias("b")).select("key", "b.output", "b.error", "b.calls")

    def ask(self, df: DataFrame, column: str, to: str, factory: Callable[[], Provider], model: str, batch: int = 16, again: bool = False) -> DataFrame:
        """df with a provider's output for a column, and its error where it has none (to and to_error).

        Only inputs that the ledger lacks are sent, equal ones once; again: also those that failed before. What comes back
        is in the ledger before it is joined, so a run that is stopped in between has lost a task's calls at most. A null
        input is not sent and has no output.
        """
        key = F.sha2(F.concat(F.lit(model), F.lit("\x1f"), F.col(column)), 256)
        held = self.read()
        known = held if not again else held.filter("error IS NULL")
        asked = df.filter(F.col(column).isNotNull()).select(key.alias("key"), F.col(column).alias("input")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            provider = None
            for f in frames:
                provider = provider or factory()
                inputs, keys = f["input"].tolist(), f["key"].tolist()
                for i in range(0, len(inputs), batch):
                    calls = [0]
                    made = answers(provider, inputs[i : i + batch], calls)
                    n = len(made)
                    yield pd.DataFrame({"key": keys[i : i + n], "output": [o for o, _ in made], "error": [e for _, e in made], "calls": [calls[0]] + [0] * (n - 1)})

        made = stored(asked.select("key", "input").mapInPandas(work, ROWS), "calls")  # one run of the provider, whatever reads it
        if not made.isEmpty():
            run = f"{self.spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]:020d}-{uuid.uuid4().hex}"
            made.withColumn("run", F.lit(run)).write.parquet(f"{self.path}/{run}")
        told = self.read().select(F.col("key").alias("__key"), F.col("output").alias(to), F.col("error").alias(f"{to}_error"))
        kept = [c for c in df.columns if c not in (to, f"{to}_error")]
        return df.select(*kept).join(told, key == F.col("__key"), "left").select(*kept, to, f"{to}_error")
