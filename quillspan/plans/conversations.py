"""Conversations: their state turn by turn, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators.conversation import folded
from ..sources import tables as S
from ..sources.scratch import new_path
from ..streaming import streams as X
from ..streaming import trips
from .kit import Plans

P = Plans()


def _states(rows: str) -> str:
    """s: the state after each turn of a relation as S.UPDATES is, in order of turn, role and hash; i numbers the turns."""
    last = lambda when, value: f"last_value(CASE WHEN valid AND {when} THEN {value} END IGNORE NULLS) OVER (PARTITION BY e.conv_id, epoch ORDER BY e.i ROWS UNBOUNDED PRECEDING)"
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, h) AS i FROM {rows}),
e AS (SELECT *, sum(CASE WHEN valid AND len % 29 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS epoch FROM n),
w AS (SELECT conv_id, epoch, i, 'p' || len % 13 AS p, TRUE AS held FROM e WHERE valid UNION ALL SELECT conv_id, epoch, i, 'p' || turn % 13, FALSE FROM e WHERE valid AND turn % 13 <> len % 13),
l AS (SELECT e.conv_id, e.i, w.p, arg_max(w.held, w.i) AS held FROM e JOIN w ON w.conv_id = e.conv_id AND w.epoch = e.epoch AND w.i <= e.i GROUP BY ALL),
g AS (SELECT conv_id, i, string_agg(p, ',' ORDER BY p) AS places FROM l WHERE held GROUP BY ALL),
s AS (SELECT e.conv_id, turn, role, e.i, {last("len % 3 = 0", "'d' || len % 11")} AS destination, {last("len % 4 = 1", "'b' || len % 5")} AS temporary_budget,
 {last("len % 5 = 2", "'2026-05-1' || len % 10")} AS date_from, {last("len % 5 = 2", "strftime(('2026-05-1' || len % 10)::DATE + (len % 7 - 1)::INT, '%Y-%m-%d')")} AS date_to, {last("len % 5 = 2", "(len % 7)::INT")} AS duration_days,
 coalesce(places, '') AS places, e.i AS turns, sum((NOT valid)::INT) OVER (PARTITION BY e.conv_id ORDER BY e.i ROWS UNBOUNDED PRECEDING)::BIGINT AS kept_out
 FROM e LEFT JOIN g ON g.conv_id = e.conv_id AND g.i = e.i)"""


_SHOWN = ("destination", "temporary_budget", "date_from", "date_to", "duration_days", "turns", "kept_out")


@P.query("turn_fold", f"WITH {_states(S.UPDATES)} SELECT conv_id, turn, role, {', '.join(_SHOWN)}, places FROM s")
def turn_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's state after each of its turns, folded in order."""
    states = folded(S.updates(spark, d), "conv_id", ["turn", "role", "h"], "reply")
    return states.select("conv_id", "turn", "role", *[F.col(f"state.{c}").alias(c) for c in _SHOWN], F.array_join(F.array_sort("state.selected_places"), ",").alias("places"))


@P.query("trip_states", f"WITH {_states(f'(SELECT DISTINCT * FROM {S.UPDATES})')} SELECT conv_id, {', '.join(_SHOWN)}, places FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1")
def trip_states(spark: SparkSession, d: str) -> DataFrame:
    """The state that a stream of the turns leaves for each conversation; repeated rows count once."""
    turns = S.bound(X.stream_of(spark, d, "conversations"), S.UPDATE)
    place = F.concat(F.format_string("%010d ", F.col("turn")), F.coalesce("role", F.lit("")), F.lit(" "), F.coalesce("h", F.lit("")))
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("turn") * 60)
    with trips.state_store(spark):
        out = X.drained(trips.trip_states(turns.select("conv_id", place.alias("place"), "reply", at.alias("at")), "30 days", 10**10), "trips", "update")
    return trips.latest_states(out).select("conv_id", *_SHOWN, F.array_join(F.array_sort("selected_places"), ",").alias("places"))


_SET = f"""t AS (SELECT conv_id, conv_id // 4 AS u, turn, role, text, coalesce(length(text), 0) AS n, CASE WHEN conv_id % 11 = 0 THEN turn + 2 ELSE turn + 1 END AS turn_id FROM conversations),
u AS (SELECT u, count(DISTINCT conv_id) AS convs FROM t GROUP BY u), c AS (SELECT conv_id, u, count(*) AS turns, list(turn_id ORDER BY turn_id) AS ids FROM t GROUP BY conv_id, u),
k AS (SELECT u, conv_id, n, 'city' AS key, 'c' || n % 6 AS value FROM t UNION ALL SELECT u, conv_id, n, CASE WHEN n % 8 = 0 THEN 'mood' ELSE 'budget' END, CASE WHEN n % 5 = 0 THEN 'gold' ELSE 'low' END FROM t
 UNION ALL SELECT u, conv_id, n, 'city', 'c' || n % 6 FROM t WHERE n % 10 = 0 UNION ALL SELECT u, conv_id, n, 'place_type', 'city' FROM t WHERE n % 13 = 0),
x AS (SELECT 'unknown_style' AS rule, u FROM u WHERE u % 3 = 0 UNION ALL SELECT 'unknown_budget_level', u FROM u WHERE u % 4 = 0 UNION ALL SELECT 'no_list', u FROM u WHERE u % 6 = 0 UNION ALL SELECT 'repeated_memory', u FROM u WHERE u % 5 = 0
 UNION ALL SELECT 'number_of_conversations', u FROM u WHERE convs <> 4 UNION ALL SELECT 'number_of_turns', u FROM c WHERE turns <> 4 UNION ALL SELECT 'turns_in_order', u FROM c WHERE ids <> [1, 2, 3, 4]
 UNION ALL SELECT 'unknown_intent', u FROM t WHERE n % 7 = 0 UNION ALL SELECT 'unknown_operation', u FROM t WHERE n % 9 = 0 UNION ALL SELECT 'empty_query', u FROM t WHERE n % 19 = 0 OR trim(coalesce(text, '')) = ''
 UNION ALL SELECT 'unknown_memory', u FROM t WHERE n % 4 = 3 UNION ALL SELECT 'omitted_memory', u FROM t WHERE n % 4 <> n % 3 UNION ALL SELECT 'repeated_constraint', u FROM t WHERE n % 10 = 0
 UNION ALL SELECT 'unknown_constraint', u FROM k WHERE key = 'mood' UNION ALL SELECT 'place_type_is_a_location', u FROM k WHERE key = 'place_type' UNION ALL SELECT 'constraint_value', u FROM k WHERE key = 'budget' AND value = 'gold'
 UNION ALL SELECT 'unknown_city', u FROM k WHERE key = 'city' AND value NOT IN (SELECT 'c' || length(text) % 5 FROM documents WHERE text IS NOT NULL))"""
_ALLOWED = D.Vocabulary(("family", "culture"), ("hiking",), ("low",), ("itinerary",), ("plan",), {"budget": ("low",)}, 4, 4)


@P.query("dataset_rules", f"WITH {_SET} SELECT rule, count(*) AS violations, count(DISTINCT u) AS users FROM x GROUP BY rule")
def dataset_rules(spark: SparkSession, d: str) -> DataFrame:
    """A data set of users with four conversations each, written as JSON, read under its schema and held against all rules."""
    path = new_path(spark, "users")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    part = lambda m, name: F.concat(F.lit(name), (n % m).cast("string"))
    city = F.struct(F.lit("city").alias("key"), part(6, "c").alias("value"))
    second = F.struct(F.when(n % 8 == 0, "mood").otherwise("budget").alias("key"), F.when(n % 5 == 0, "gold").otherwise("low").alias("value"))
    place = F.struct(F.lit("place_type").alias("key"), F.lit("city").alias("value"))
    some = lambda when, item: F.when(when, F.array(item)).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    turn = F.struct(
        F.when(F.col("conv_id") % 11 == 0, F.col("turn") + 2).otherwise(F.col("turn") + 1).alias("turn_id"), F.when(n % 19 == 0, " ").otherwise(F.substring("text", 1, 20)).alias("query"), F.when(n % 7 == 0, "gossip").otherwise("itinerary").alias("intent"),
        F.when(n % 9 != 0, "plan").alias("operation"), F.array(part(4, "m")).alias("relevant_memory_ids"), F.array(F.struct(F.lit("interest").alias("key"), part(3, "v").alias("value"))).alias("applicable_personalization"),
        F.concat(F.array(city, second), some(n % 10 == 0, city), some(n % 13 == 0, place)).alias("query_constraints"),
    )
    each = S.read(spark, d, "conversations").select(F.floor(F.col("conv_id") / 4).alias("u"), "conv_id", turn.alias("turn"))
    held = each.groupBy("u", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    users = held.groupBy("u").agg(F.collect_list(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), "turns")).alias("conversations"))
    u = F.col("u")
    profile = F.struct(
        F.array(F.lit("family"), F.when(u % 3 == 0, "party").otherwise("culture")).alias("preferred_travel_styles"), F.array(F.lit("hiking")).alias("preferred_activities"), F.when(u % 4 != 0, "low").alias("budget_level"),
        F.when(u % 6 != 0, F.array(F.lit("food"))).alias("interests"), F.array().cast("array<string>").alias("avoid"),
    )
    memory = lambda i: F.struct(F.lit(f"m{i}").alias("memory_id"), F.lit(f"k{i}").alias("key"), F.lit(f"v{i}").alias("value"))
    memories = F.array(*[memory(i) for i in range(3)])
    users.select(F.concat(F.lit("U"), u.cast("string")).alias("user_id"), profile.alias("profile"), F.when(u % 5 == 0, F.concat(memories, F.array(memory(0)))).otherwise(memories).alias("memories"), "conversations").write.json(path)
    cities = S.read(spark, d, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("c"), (F.char_length("text") % 5).cast("string")).alias("city"))
    return D.violations(spark.read.schema(D.USER).json(path), cities, _ALLOWED)
