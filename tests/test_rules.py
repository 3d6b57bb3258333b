"""Robots rules, shapes of replies."""

import json
import math
import random

from pyspark.sql import functions as F

from quillspan.operators import evaluation, replies, robots


def test_robots_rules_of_files(spark):
    text = "# c\nUser-agent: Bot\nUser-agent: other\nDisallow: /private # no\nAllow: /private/open$\nDisallow: /*.pdf\n\nUser-agent: *\nDisallow: /\nAllow: /pub*/x\nSitemap: https://a/x\nnonsense"
    files = [("a.org", text), ("B.org", ""), ("c.org", None), ("d.org", "User-agent: bot\nDisallow:"), ("e.org", "Disallow: /\nUser-agent: *\nDisallow: /caf%C3%A9")]
    table = robots.robots_table(spark.createDataFrame(files, "h string, t string"), "h", "t")
    urls = {
        "https://a.org/private/x": (False, False), "https://a.org/private/open": (True, False), "https://A.org/private/open2": (False, False), "https://a.org/doc.pdf?x=1": (False, False), "https://a.org": (True, False),
        "https://a.org/public/x/y": (True, True), "https://b.org/any": (True, True), "https://c.org/": (None, None), "https://nofile.org/": (None, None), "https://d.org/x": (True, True), "https://e.org/café": (False, False), "https://e.org/caf%C3%A9/1": (False, False),
        "https://user@e.org/x?q=%zz": (True, True), "no url": (None, None), "http://b.org?x#y": (True, True),
    }
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string")
    got = [{r.url: r.may_fetch for r in robots.with_robots(df, "url", table, agent).collect()} for agent in ("bot", "stranger")]
    assert {u: (got[0][u], got[1][u]) for u in urls} == urls and got[0][None] is None


def test_items_of_replies_in_any_shape(spark):
    items = [{"chunk_index": 1, "t": "a"}, {"chunk_index": 2, "t": "b"}, {"t": "no key"}, {"chunk_index": 9, "t": "not asked"}, {"chunk_index": 1, "t": "again"}]
    said = [json.dumps(x) for x in ({"items": items}, {"results": items}, items, {"other": 1, "chunks": items})] + ["Sure:\n" + json.dumps({"data": items}) + "\nbye", "```json\n" + json.dumps(items) + "\n```", json.dumps(items[0]), "none", "{", "[1]", "", None, json.dumps({"items": []})]
    df = spark.createDataFrame([(i, [1, 2, 3], s) for i, s in enumerate(said)], "b int, asked array<bigint>, reply string")
    got = {}
    for r in replies.assigned_items(df, "b", "asked", "reply", "chunk_index bigint, t string", "chunk_index").collect():
        got.setdefault(r.b, set()).add((r.chunk_index, r.t))
    assert got == {**{i: {(1, "a"), (2, "b")} for i in range(6)}, 6: {(1, "a")}}
    shapes = df.select("b", F.size(replies.batch_items(F.col("reply"), "chunk_index bigint, t string", "chunk_index")).alias("n")).collect()
    assert {r.b: r.n for r in shapes}[12] == 0 and {r.b: r.n for r in shapes}[7] in (-1, None)


def test_rules_of_a_nested_data_set(spark):
    from quillspan.operators import dataset as D

    turn = lambda i, **x: {"turn_id": i, "query": "q", "intent": "plan", "operation": "find", "relevant_memory_ids": ["m1"], "applicable_personalization": [{"key": "likes", "value": "other"}], "query_constraints": [{"key": "city", "value": "Hue"}], **x}
    user = lambda name, turns=None, **x: {"user_id": name, "profile": {"preferred_travel_styles": ["slow"], "preferred_activities": [], "budget_level": "low", "interests": [], "avoid": []}, "memories": [{"memory_id": "m1", "key": "likes", "value": "art"}], "conversations": [{"conversation_id": "c1", "turns": turns or [turn(1), turn(2)]}], **x}
    allowed = D.Vocabulary(("slow",), ("walk",), ("low",), ("plan",), ("find",), {"budget": ("low",)}, 1, 2)
    cities = spark.createDataFrame([("Hue",), ("Hue",)], "city string")

    def broken(*users):
        df = spark.read.schema(D.USER).json(spark.sparkContext.parallelize([json.dumps(u) for u in users]))
        return {r.rule: (r.violations, r.users) for r in D.violations(df, cities, allowed).collect()}

    assert broken(user("a"), user("b")) == {} and broken(user("a"), user("a")) == {"repeated_user": (1, 1)}
    wrong = [turn(1, query=" ", intent=None, operation="x", relevant_memory_ids=["m9"]), turn(3, query_constraints=[{"key": "city", "value": "Rome"}, {"key": "city", "value": "Rome"}, {"key": "mood", "value": "x"}, {"key": "place_type", "value": "city"}, {"key": "budget", "value": "gold"}])]
    got = broken(user("a", wrong, profile=None, memories=[{"memory_id": "m1", "value": "other"}, {"memory_id": "m1", "key": "likes", "value": "art"}]), user("b", [turn(1)]), user("c", conversations=None))
    assert got == {
        "unknown_budget_level": (1, 1), "no_list": (2, 1), "repeated_memory": (1, 1), "empty_query": (1, 1), "unknown_intent": (1, 1), "unknown_operation": (1, 1), "unknown_memory": (1, 1), "omitted_memory": (1, 1), "turns_in_order": (2, 2),
        "unknown_city": (2, 1), "repeated_constraint": (1, 1), "unknown_constraint": (1, 1), "place_type_is_a_location": (1, 1), "constraint_value": (1, 1), "number_of_turns": (1, 1), "number_of_conversations": (1, 1),
    }


def test_weak_metrics_agree_with_their_definition(spark):
    r = random.Random(12)
    vocabulary = ["Hue", "Hoi_An", "bay", "old town", "market", "food", "pier"]
    runs, cases = [], []
    for q in range(60):
        ids = r.sample(range(40), 12)
        runs += [(q, i, n + 1, " ".join(r.choices(vocabulary, k=r.randrange(4)))) for n, i in enumerate(ids[: r.randrange(13)])]
        cases.append((q, r.sample(range(40), r.randrange(3)) if q % 2 else [], r.sample(vocabulary, r.randrange(3)), r.sample(vocabulary, r.randrange(2)), r.sample(vocabulary, r.randrange(3))))
    flat = lambda t: " ".join(t.lower().replace("_", " ").split())
    want = {}
    for q, relevant, places, locations, keywords in cases:
        own = sorted((n, i, t) for p, i, n, t in runs if p == q)
        says = lambda t, v: sum(flat(x) in flat(t) for x in v)  # noqa: E731, B023
        weak = lambda t: 3 if says(t, places) else 2 if says(t, locations) and says(t, keywords) else 1 if says(t, locations) or says(t, keywords) >= 2 else 0  # noqa: E731, B023
        grades = [(n, (3 if i in relevant else 0) if relevant else weak(t)) for n, i, t in own]
        n = len(set(relevant)) if relevant else len(places)
        gain = lambda g, i: (2**g - 1) / math.log2(i + 1)
        ideal = sum(gain(3, i) for i in range(1, min(n, 5) + 1))
        top = [t for _, _, t in own[:10]]
        recall = len({i for _, i, _ in own[:10]} & set(relevant)) / len(set(relevant)) if relevant else len({p for p in places for t in top if flat(p) in flat(t)}) / len(places) if places else 0
        first = min((m for m, g in grades if g), default=None)
        want[q] = (recall, sum(g > 0 for _, g in grades[:10]) / 10, sum(gain(g, m) for m, g in grades[:5]) / ideal if ideal else 0, 1 / first if first else 0)
    run = spark.createDataFrame(runs, "query_id long, id long, rank int, text string")
    given = spark.createDataFrame(cases, "query_id long, relevant array<long>, places array<string>, locations array<string>, keywords array<string>")
    got = {x.query_id: (x.recall, x.precision, x.ndcg, x.mrr) for x in evaluation.weak_metrics(run, given).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for q in want for a, b in zip(got[q], want[q]))
