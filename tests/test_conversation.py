"""The state of conversations: patches, slices and the stream."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.operators import conversation as C

ITEMS = st.lists(st.sampled_from("abcd"), max_size=3)
REPLIES = st.one_of(
    st.fixed_dictionaries({}, optional={
        "destination": st.sampled_from(["Hue", "Hoi An"]), "temporary_budget": st.sampled_from(["low", "high"]), "summary": st.just("s  t"), "date_from": st.sampled_from(["2026-05-01", "2026-05-09", "no"]),
        "date_to": st.sampled_from(["2026-05-04", "2026-05-20"]), "duration_days": st.integers(0, 4), "selected_places": ITEMS, "trip_constraints": ITEMS, "dropped_selected_places": ITEMS, "reset": st.booleans(),
    }).map(json.dumps),
    st.sampled_from(["", "nonsense", "[1]", '{"destination": 3}', '{"selected_places": "x"}', '{"selected_places": [1]}', '{"reset": 1}', None]),
)


def brute(replies):
    """State after each reply, by the rules as they are said: one step at a time on a plain record."""
    state, out = {"turns": 0, "kept_out": 0, "lists": {k: [] for k in C.LISTS}}, []
    for reply in replies:
        state["turns"] += 1
        patch = C.patch_of(reply)
        if patch["kept_out"]:
            state["kept_out"] += 1
        else:
            given = json.loads(reply)
            if given.get("reset"):
                state = {"turns": state["turns"], "kept_out": state["kept_out"], "lists": {k: [] for k in C.LISTS}}
            for k in C.SINGLE:
                if given.get(k) is not None:
                    state[k] = given[k]
            if any(given.get(k) is not None for k in C.DATES):
                state.update(C._dates(given))
            for k in C.LISTS:
                state["lists"][k] = [x for x in state["lists"][k] if x not in (given.get(f"dropped_{k}") or [])]
                state["lists"][k] += [x for i, x in enumerate(given.get(k) or []) if x not in state["lists"][k] and x not in given[k][:i]]
        summary = state.get("summary")
        out.append((state.get("destination"), *(state.get(k) for k in C.DATES), state.get("temporary_budget"), summary and " ".join(summary.split()), *(list(state["lists"][k]) for k in C.LISTS), state["turns"], state["kept_out"]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(REPLIES, min_size=1, max_size=12), st.integers(0, 12))
def test_any_split_of_a_conversation_folds_alike(replies, cut):
    patches = [C.patch_of(r) for r in replies]
    halves = []
    for part in (patches[:cut], patches[cut:]):
        held = C.nothing()
        for p in part:
            held = C.composed(held, p)
        halves.append(json.loads(json.dumps(held)))
    assert C.shown(C.composed(*halves)) == brute(replies)[-1]


@settings(max_examples=200, deadline=None)
@given(REPLIES, REPLIES, REPLIES)
def test_patches_are_associative(a, b, c):
    x, y, z = map(C.patch_of, (a, b, c))
    left, right = C.composed(C.composed(x, y), z), C.composed(x, C.composed(y, z))
    for state in ({**C.nothing(), "added": {"selected_places": ["d", "a"]}}, C.nothing()):
        assert C.shown(C.composed(state, left)) == C.shown(C.composed(state, right))


def test_dates_complete_each_other_and_wrong_ones_are_kept_out():
    show = lambda **x: C.shown(C.patch_of(json.dumps(x)))
    assert show(date_from="2026-05-01", duration_days=3)[1:3] == ("2026-05-01", "2026-05-03")
    assert show(date_to="2026-05-03", duration_days=3)[1:3] == ("2026-05-01", "2026-05-03")
    assert show(date_from="2026-05-01", date_to="2026-05-02", duration_days=9)[4] == 2
    for wrong in ({"date_from": "2026-05-02", "date_to": "2026-05-01"}, {"date_from": "soon"}, {"duration_days": 0}, {"duration_days": True}, {"date_from": "9999-12-31", "duration_days": 400}):
        assert show(**wrong)[-1] == 1


def made(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        reply = {k: v for k, v in {
            "destination": r.choice([None, "Hue", "Da Nang"]), "selected_places": r.choices("abcdefgh", k=r.randrange(3)), "dropped_selected_places": r.choices("abcdefgh", k=r.randrange(2)),
            "date_from": r.choice([None, "2026-05-10"]), "duration_days": r.choice([None, 2, 5]), "reset": r.random() < 0.02,
        }.items() if v}
        out.append(json.dumps(reply)[: None if r.random() < 0.9 else 5])
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_conversations_of_any_length_are_folded_in_order(spark, parts):
    said = {1: made(1, 700), 2: made(2, 5), 3: [None], None: made(4, 9), **{i: made(i, 3) for i in range(10, 40)}}
    rows = [(k, t, reply) for k, replies in said.items() for t, reply in enumerate(replies)]
    random.Random(0).shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn int, reply string")
        got = C.folded(df, "conv_id", ["turn"], "reply").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {(r.conv_id, r.turn): tuple(r.state) for r in got} == {(k, t): s for k, replies in said.items() for t, s in enumerate(brute(replies))}


def test_a_long_conversation_is_several_slices(spark):
    from quillspan.operators.numbering import in_slices

    df = spark.range(5000).selectExpr("1L AS conv_id", "cast(id AS int) AS turn", "'{}' AS reply")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert in_slices(df, ["conv_id"], [F.col("turn")]).select("slice").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, reply string")
    assert C.folded(none, "conv_id", ["turn"], "reply").count() == 0
