"""A conversation's state: what its turns say of a trip, merged field by field.

A turn's reply is a patch: fields that it gives take the place of older ones, dates together; items are added to lists or
dropped from them; a reset forgets what was before. A reply that breaks a rule changes nothing but the count of such.
Patches are composable (two in a row are one patch), so a conversation of any length is folded slice by slice: each slice
to one patch, these along the conversation, and each turn from where its slice starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import in_slices

#: Fields of one value, and lists; words of a summary and items of a list that are shown.
SINGLE, LISTS = ("destination", "temporary_budget", "summary"), ("selected_places", "trip_constraints")
DATES = ("date_from", "date_to", "original_date_text", "duration_days")
MOST_WORDS, MOST_ITEMS = 180, 30
SHOWN = "destination string, date_from string, date_to string, original_date_text string, duration_days int, temporary_budget string, summary string, selected_places array<string>, trip_constraints array<string>, turns long, kept_out long"

Patch = dict[str, Any]


def nothing() -> Patch:
    return {"reset": False, "fields": {}, "added": {}, "dropped": {}, "turns": 0, "kept_out": 0}


# ---- one reply

def _day(value: Any) -> date | None:
    return None if value is None else date.fromisoformat(value)


def _dates(given: dict) -> dict:
    """The dates that a reply gives, made consistent: two of start, end and duration make the third."""
    start, end, days = _day(given.get("date_from")), _day(given.get("date_to")), given.get("duration_days")
    if days is not None and (isinstance(days, bool) or not isinstance(days, int) or days < 1):
        raise ValueError("a duration is a number of days")
    if start and end:
        if end < start:
            raise ValueError("the end is before the start")
        days = (end - start).days + 1
    elif start and days:
        end = start + timedelta(days=days - 1)
    elif end and days:
        start = end - timedelta(days=days - 1)
    text = given.get("original_date_text")
    if text is not None and not isinstance(text, str):
        raise ValueError("a text is a string")
    return {"date_from": start and start.isoformat(), "date_to": end and end.isoformat(), "original_date_text": text, "duration_days": days}


def patch_of(reply: str | None) -> Patch:
    """A reply as a patch. One that is no JSON object, or has a field of a wrong type or dates that can't be, is kept out."""
    out = nothing()
    try:
        given = json.loads(reply or "")
        if not isinstance(given, dict):
            raise ValueError("no object")
        fields = {k: given[k] for k in SINGLE if given.get(k) is not None}
        if any(not isinstance(v, str) for v in fields.values()):
            raise ValueError("a field is a string")
        if any(given.get(k) is not None for k in DATES):
            fields["dates"] = _dates(given)
        added = {k: given.get(k) or [] for k in LISTS}
        dropped = {k: given.get(f"dropped_{k}") or [] for k in LISTS}
        for items in (*added.values(), *dropped.values()):
            if not isinstance(items, list) or any(not isinstance(x, str) for x in items):
                raise ValueError("a list is one of strings")
        reset = given.get("reset") or False
        if not isinstance(reset, bool):
            raise ValueError("reset is true or false")
    except (ValueError, TypeError, OverflowError):
        return {**out, "turns": 1, "kept_out": 1}
    full = lambda lists: {k: list(dict.fromkeys(v)) for k, v in lists.items() if v}
    return {**out, "reset": reset, "fields": fields, "added": full(added), "dropped": full(dropped), "turns": 1}


def composed(first: Patch, then: Patch) -> Patch:
    """The patch that does what two do, one after the other."""
    counts = {k: first[k] + then[k] for k in ("turns", "kept_out")}
    if then["reset"]:
        return {**then, **counts}
    added, dropped = dict(first["added"]), dict(first["dropped"])
    for name in LISTS:
        gone, new = then["dropped"].get(name, ()), then["added"].get(name, ())
        if gone:
            out = set(gone)
            added[name] = [x for x in added.get(name, ()) if x not in out]
            dropped[name] = list(dict.fromkeys([*dropped.get(name, ()), *gone]))
        if new:
            added[name] = list(dict.fromkeys([*added.get(name, ()), *new]))
    return {"reset": first["reset"], "fields": {**first["fields"], **then["fields"]}, "added": added, "dropped": dropped, **counts}


def shown(state: Patch) -> tuple:
    """A state's columns: a patch applied to nothing."""
    dates, fields = state["fields"].get("dates") or {}, state["fields"]
    summary = fields.get("summary")
    return (
        fields.get("destination"), *(dates.get(k) for k in DATES), fields.get("temporary_budget"), " ".join(summary.split()[:MOST_WORDS]) if summary is not None else None,
        *(state["added"].get(k, [])[:MOST_ITEMS] for k in LISTS), state["turns"], state["kept_out"],
    )


# ---- conversations

def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def folded(turns: DataFrame, by: str, order: list[str], reply: str) -> DataFrame:
    """(by, *order, state): turns with the state after each, a struct of SHOWN.

    order has to be total but for equal turns. A null reply is kept out; a null key is a conversation of its own. A long
    conversation is several slices, which different tasks fold.
    """
    sliced = in_slices(turns.select(by, *order, reply), [by], [F.col(c) for c in order])
    kind = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in sliced.schema}
    runs = lambda df, *more: df.repartition(by, "slice").sortWithinPartitions(by, "slice", *more)

    def to_patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, nothing(), []
        for batch in batches:
            for *key, said in _columns(batch, by, "slice", reply):
                if key != at and at is not None:
                    out.append((*at, json.dumps(held)))
                held, at = composed(held if key == at else nothing(), patch_of(said)), key
            kind_of_key = batch.schema.field(by).type
            yield _batch(out, kind_of_key)
            out = []
        if at is not None:
            yield _batch([(*at, json.dumps(held))], kind_of_key)

    def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[by, "slice", "patch"])

    def starts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, first = None, nothing(), True
        for batch in batches:
            out = []
            for key, number, patch in _columns(batch, by, "slice", "patch"):
                held, first = (nothing(), False) if first or key != at else (held, False)
                out.append((key, number, json.dumps(held)))
                held, at = composed(held, json.loads(patch)), key
            yield _batch(out, batch.schema.field(by).type)

    def to_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, nothing()
        for batch in batches:
            states = []
            for key, number, said, start in _columns(batch, by, "slice", reply, "start"):
                if (key, number) != at:
                    at, held = (key, number), json.loads(start) if start else nothing()
                held = composed(held, patch_of(said))
                states.append(dict(zip(names, shown(held), strict=True)))
            kept = [batch.column(c) for c in (by, *order)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(states, arrow)], names=[by, *order, "state"])

    shape = T._parse_datatype_string(SHOWN)
    names = shape.names
    strings = pa.list_(pa.string())
    arrow = pa.struct([(f.name, strings if isinstance(f.dataType, T.ArrayType) else {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in shape])
    patches = runs(sliced, *order).select(by, "slice", reply).mapInArrow(to_patches, f"{kind[by]}, slice int, patch string")
    several = patches.groupBy(F.col(by).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    long = patches.join(several, F.col(by).eqNullSafe(F.col("__k")), "left_semi")
    starts = long.repartition(by).sortWithinPartitions(by, "slice").mapInArrow(starts_of, f"{kind[by]}, slice int, patch string")
    start = starts.select(F.col(by).alias("__k"), F.col("slice").alias("__s"), F.col("patch").alias("start"))
    begun = sliced.join(start, F.col(by).eqNullSafe(F.col("__k")) & (F.col("slice") == F.col("__s")), "left").select(by, *order, "slice", reply, "start")
    return runs(begun, *order).mapInArrow(to_states, ", ".join(kind[c] for c in (by, *order)) + f", state struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in shape)}>")
