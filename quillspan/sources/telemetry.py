"""What a run's own stages did: rows and sums that Spark counts while it works, as a table."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = "run string, stage string, position int, metric string, value double, at double"


class Telemetry:
    """Counts of the stages of one run. stage() marks a DataFrame; after an action on what was made of it, events() has its
    figures. A figure costs no pass of its own. Each stage takes part in one action."""

    def __init__(self, spark: SparkSession, run: str | None = None) -> None:
        self.spark, self.run = spark, run or uuid.uuid4().hex
        self.stages: list[tuple[str, Observation]] = []

    def stage(self, df: DataFrame, name: str, **sums: Column) -> DataFrame:
        """df, whose rows (and sums of columns, if wanted) are counted when it is computed."""
        seen = Observation(f"{self.run}-{len(self.stages)}")
        self.stages.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()])

    def events(self) -> DataFrame:
        """EVENTS, a row for each stage and metric; waits for stages that haven't been computed."""
        now = time.time()
        rows = [(self.run, name, i, k, None if v is None else float(v), now) for i, (name, seen) in enumerate(self.stages) for k, v in sorted(seen.get.items())]
        return self.spark.createDataFrame(rows, EVENTS)  # a row for each stage and metric of one run


class StreamTelemetry(StreamingQueryListener):
    """Metrics that the micro-batches of observed streams report: (query, batch, stage, metric, value).

    Mark a stream with DataFrame.observe(stage, ...) and add this listener to the session's streams.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str, str, float]] = []
        self.ended: set[str] = set()
        self.lock = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        p = event.progress
        found = [(str(p.id), p.batchId, "batch", "input", float(p.numInputRows))]
        found += [(str(p.id), p.batchId, stage, k, float(v)) for stage, row in p.observedMetrics.items() for k, v in row.asDict().items() if v is not None]
        with self.lock:
            self.rows += found

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        with self.lock:
            self.ended.add(str(event.id))
            self.lock.notify_all()

    def events(self, spark: SparkSession, query: str, wait: float = 30.0) -> DataFrame:
        """What a query has reported; waits for its end, as reports come a little later than the rows."""
        with self.lock:
            self.lock.wait_for(lambda: query in self.ended, wait)
            rows = [r for r in self.rows if r[0] == query]
        return spark.createDataFrame(rows, "query string, batch long, stage string, metric string, value double")
