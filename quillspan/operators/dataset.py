"""Integrity of a generated data set: users with a profile, memories and conversations, nested as they are written."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER = """user_id string, profile struct<preferred_travel_styles: array<string>, preferred_activities: array<string>, budget_level: string, interests: array<string>, avoid: array<string>>,
memories array<struct<memory_id: string, key: string, value: string>>, conversations array<struct<conversation_id: string, turns: array<struct<turn_id: int, query: string, intent: string, operation: string,
relevant_memory_ids: array<string>, applicable_personalization: array<struct<key: string, value: string>>, query_constraints: array<struct<key: string, value: string>>>>>>"""
#: Names that a constraint can have; types of places that are locations.
KEYS = ("country", "region", "city", "province", "place_type", "activity", "travel_style", "suitable_for", "budget", "duration_days", "date_from", "date_to", "near_place", "max_distance_km")
GEOGRAPHIC = ("country", "city", "province", "region")


@dataclass(frozen=True)
class Vocabulary:
    """What is allowed; values: of constraints, by their key. Cities are a table."""

    styles: tuple[str, ...]
    activities: tuple[str, ...]
    budgets: tuple[str, ...]
    intents: tuple[str, ...]
    operations: tuple[str, ...]
    values: dict[str, tuple[str, ...]]
    conversations: int
    turns: int


def _count(items: Column, wrong) -> Column:  # noqa: ANN001
    return F.size(F.filter(F.coalesce(items, F.array()), lambda x: F.coalesce(wrong(x), F.lit(False))))


def _repeats(items: Column) -> Column:
    """How many items are more than there are different ones."""
    held = F.coalesce(items, F.array())
    return F.size(held) - F.size(F.array_distinct(held))


def rules(v: Vocabulary) -> dict[str, Column]:
    """By rule, how often a user breaks it."""
    profile, memories, conversations = F.col("profile"), F.col("memories"), F.coalesce("conversations", F.array())
    turns = F.flatten(F.transform(conversations, lambda c: F.coalesce(c["turns"], F.array())))
    constraints = F.flatten(F.transform(turns, lambda t: F.coalesce(t["query_constraints"], F.array())))
    ids = F.transform(F.coalesce(memories, F.array()), lambda m: m["memory_id"])
    unknown = lambda x, allowed: x.isNull() | ~x.isin(*allowed)
    values = [(F.lit(k), allowed) for k, allowed in v.values.items()]

    def omitted(t: Column) -> Column:
        """Memories that apply to a turn, by their key or their value, and that it doesn't name."""
        said = F.coalesce(t["applicable_personalization"], F.array())
        applies = lambda m: F.exists(said, lambda a: (a["key"] == m["key"]) | (a["value"] == m["value"]))
        due = F.transform(F.filter(F.coalesce(memories, F.array()), lambda m: m["memory_id"].isNotNull() & F.coalesce(applies(m), F.lit(False))), lambda m: m["memory_id"])
        return F.size(F.array_except(due, F.coalesce(t["relevant_memory_ids"], F.array()))) > 0

    def wrong_value(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [(c["key"] == k) & unknown(c["value"], allowed) for k, allowed in values], F.lit(False))

    return {
        "unknown_style": _count(profile["preferred_travel_styles"], lambda x: unknown(x, v.styles)),
        "unknown_activity": _count(profile["preferred_activities"], lambda x: unknown(x, v.activities)),
        "unknown_budget_level": unknown(profile["budget_level"], v.budgets).cast("int"),
        "no_list": profile["interests"].isNull().cast("int") + profile["avoid"].isNull().cast("int"),
        "repeated_memory": _repeats(ids),
        "number_of_conversations": (F.size(conversations) != v.conversations).cast("int"),
        "repeated_conversation": _repeats(F.transform(conversations, lambda c: c["conversation_id"])),
        "number_of_turns": _count(conversations, lambda c: F.size(F.coalesce(c["turns"], F.array())) != v.turns),
        "turns_in_order": _count(conversations, lambda c: ~F.transform(F.coalesce(c["turns"], F.array()), lambda t: t["turn_id"]).eqNullSafe(F.sequence(F.lit(1), F.lit(v.turns)))),
        "unknown_intent": _count(turns, lambda t: unknown(t["intent"], v.intents)),
        "unknown_operation": _count(turns, lambda t: unknown(t["operation"], v.operations)),
        "empty_query": _count(turns, lambda t: F.trim(F.coalesce(t["query"], F.lit(""))) == ""),
        "unknown_memory": _count(turns, lambda t: F.size(F.array_except(F.coalesce(t["relevant_memory_ids"], F.array()), ids)) > 0),
        "omitted_memory": _count(turns, omitted),
        "repeated_constraint": _count(turns, lambda t: _repeats(t["query_constraints"]) > 0),
        "unknown_constraint": _count(constraints, lambda c: unknown(c["key"], KEYS)),
        "place_type_is_a_location": _count(constraints, lambda c: (c["key"] == "place_type") & c["value"].isin(*GEOGRAPHIC)),
        "constraint_value": _count(constraints, wrong_value),
    }


def violations(users: DataFrame, cities: DataFrame, v: Vocabulary) -> DataFrame:
    """(rule, violations, users): how often each rule is broken, and by how many users; no row for one that holds.

    users: USER; cities: city, those that constraints may name. Rules of a user's own row are told in one pass; those that
    look beyond it, unknown cities and repeated users, are joins and aggregates.
    """
    told = F.array(*[F.struct(F.lit(name).alias("rule"), n.cast("long").alias("n")) for name, n in rules(v).items()])
    own = users.select(F.explode(F.filter(told, lambda x: x["n"] > 0)).alias("x")).select("x.*")
    turns = users.select("user_id", F.explode("conversations").alias("c")).select("user_id", F.explode("c.turns").alias("t"))
    named = turns.select("user_id", F.explode("t.query_constraints").alias("k")).filter("k.key = 'city'").select("user_id", F.col("k.value").alias("city"))
    unknown = named.join(cities.select("city").distinct(), "city", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_city").alias("rule"), "n")
    again = users.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0").select(F.lit("repeated_user").alias("rule"), "n")
    return reduce(DataFrame.unionByName, (own, unknown, again)).groupBy("rule").agg(F.sum("n").alias("violations"), F.count(F.lit(1)).alias("users"))
