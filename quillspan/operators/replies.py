"""Replies of models that hold a batch of items, whatever they are wrapped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Names that a list of items goes by.
WRAPPERS = ("items", "chunks", "results", "data", "metadata")


def batch_items(reply: Column, item: str, key: str, wrappers: tuple[str, ...] = WRAPPERS) -> Column:
    """The items of a reply, an array of struct<item>: a list, a list under one of the names, or one item itself, which has
    the key. What a text around the JSON says is passed over; items without the key go; null if there is no JSON of these."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```[a-z]*\s*|\s*```$", "")
    as_list = F.when(bare.startswith("["), F.from_json(bare, f"array<struct<{item}>>"))
    held = T.json_in(bare)
    named = [F.from_json(F.get_json_object(held, f"$.{w}"), f"array<struct<{item}>>") for w in wrappers]
    one = F.from_json(held, item)
    alone = F.when(one[key].isNotNull(), F.array(one))
    found = F.coalesce(as_list, F.when(~bare.startswith("["), F.coalesce(*named, alone)))
    return F.filter(found, lambda x: x[key].isNotNull())


def assigned_items(batches: DataFrame, by: str, inputs: str, reply: str, item: str, key: str) -> DataFrame:
    """(by, key, ...): an item for each input of a batch that its reply has one for, the first of equal keys; items of keys
    that weren't asked are passed over. inputs: an array of keys."""
    found = batches.select(by, inputs, F.posexplode(batch_items(F.col(reply), item, key)).alias("at", "x"))
    asked = found.filter(F.array_contains(inputs, F.col(f"x.{key}")))
    first = asked.groupBy(by, F.col(f"x.{key}").alias(key)).agg(F.min_by("x", "at").alias("x"))
    return first.select(by, "x.*")
