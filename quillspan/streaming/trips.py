"""Conversation state as a stream: arbitrary state of several variables, with validation and expiry.

Turns may come late, twice or in any order: every value is kept with the place of the turn that gave it, and the later one
holds. So a stream ends with the state that the batch fold has, however its rows were cut into micro-batches.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversation import LISTS, SHOWN, patch_of, shown

#: Transform-with-state keeps its variables in this store, which comes with Spark.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = f"conv_id long, {SHOWN}, status string"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session's state store for queries that start within; the former setting afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Trips(StatefulProcessor):
    """Rows: conv_id, place (a string that orders a conversation's turns), reply, and at (event time).

    Variables: values by field with the place that gave them; items with the place of the last word on them; the places
    seen, with whether their reply was kept out; the last reset. An idle conversation's timer clears all of them.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "name string", "place string, value string")
        self.items = handle.getMapState("items", "list string, item string", "place string, held boolean")
        self.turns = handle.getMapState("turns", "place string", "kept_out boolean")
        self.reset = handle.getValueState("reset", "place string")
        self.until = handle.getValueState("until", "at long")

    def _newer(self, held: tuple | None, place: str, since: str) -> bool:
        return place >= since and (held is None or place >= held[0])

    def _take(self, place: str, reply: str | None) -> None:
        if self.turns.containsKey((place,)):
            return  # came before
        patch = patch_of(reply)
        self.turns.updateValue((place,), (bool(patch["kept_out"]),))
        if patch["kept_out"]:
            return  # the state before it holds
        since = self.reset.get()[0] if self.reset.exists() else ""
        if patch["reset"] and place > since:
            self.reset.update((place,))
            since = place
            for state in (self.fields, self.items):
                for key, value in list(state.iterator()):
                    if value[0] < place:
                        state.removeKey(tuple(key))
        for name, value in patch["fields"].items():
            if self._newer(self.fields.getValue((name,)), place, since):
                self.fields.updateValue((name,), (place, json.dumps(value)))
        for held, lists in ((False, patch["dropped"]), (True, patch["added"])):
            for name, items in lists.items():
                for item in items:
                    if self._newer(self.items.getValue((name, item)), place, since):
                        self.items.updateValue((name, item), (place, held))

    def _state(self, key: Any, status: str) -> Row:
        fields = {k[0]: json.loads(v[1]) for k, v in self.fields.iterator()}
        added: dict[str, list[str]] = {name: [] for name in LISTS}
        for (name, item), (_, held) in sorted((tuple(k), tuple(v)) for k, v in self.items.iterator()):
            if held:
                added[name].append(item)
        told = [v[0] for _, v in self.turns.iterator()]
        values = shown({"fields": fields, "added": added, "turns": len(told), "kept_out": sum(told)})
        return Row(conv_id=key[0], **dict(zip([p.split(" ")[0] for p in SHOWN.split(", ")], values, strict=True)), status=status)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = self.until.get()[0] if self.until.exists() else 0
        newest = last
        for r in rows:
            self._take(r.place, r.reply)
            newest = max(newest, int(r.at.timestamp() * 1000) + self.idle_ms)
        if newest != last:
            if last:
                self.handle.deleteTimer(last)
            self.handle.registerTimer(newest)
            self.until.update((newest,))
        yield self._state(key, "open")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield self._state(key, "expired")
        for state in (self.fields, self.items, self.turns, self.reset, self.until):
            state.clear()

    def close(self) -> None:
        pass


def trip_states(turns: DataFrame, idle: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """STATE of each conversation that a micro-batch touches, lists in order of their names; and once, with the status
    expired, of one that the watermark has left idle for so long. turns: conv_id, place, reply, at (event time), as a
    stream. A null place counts as the empty string; turns later than the watermark still count while the state lives."""
    rows = turns.select("conv_id", F.coalesce("place", F.lit("")).alias("place"), "reply", "at").withWatermark("at", idle)
    return rows.groupBy("conv_id").transformWithState(statefulProcessor=Trips(idle_ms), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def latest_states(updates: DataFrame, batch: str = "__batch") -> DataFrame:
    """The last update of each conversation, of the table that a stream has written with the number of its batch."""
    rest = [c for c in updates.columns if c not in ("conv_id", batch)]
    # An expiry comes after the updates of its batch.
    order = F.struct(batch, (F.col("status") == "expired").alias("late"), *rest)
    return updates.groupBy("conv_id").agg(F.max(order).alias("s")).select("conv_id", *[F.col(f"s.{c}").alias(c) for c in rest])


