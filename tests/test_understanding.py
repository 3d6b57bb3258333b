"""Rules of requests, on sentences made from parts."""

import itertools
import json
import random
import re

from pyspark.sql import functions as F

from quillspan.operators import understanding as U
from quillspan.sources.tables import PHRASES


def test_requirements_on_the_answer_alone(spark):
    cases = [
        ("The best weather, by month", "museums in Hue", "food", 0, True), ("The best weather, by month", "museums and practical considerations", "food", 0, False),
        ("Permits for the cave", "is a permit needed", "food", 0, False), ("Climate-friendly dishes", "dishes", "food", 0, True), ("acclimate slowly", "x", "food", 0, False),
        ("Scenic views from the train", "to Hue", "food", 0, True), ("Train with photography opportunities", "photos along the coast", "food", 0, False), ("Scenic views of the old town", "x", "food", 0, False),
        ("An organized tour", "x", "food", 0, True), ("flexibility", "x", "food", 0, True), ("the specified constraints", "x", "food", 0, True), ("Recommendations for a 12-day trip", "x", "food", 0, True), ("Recommendations for a long trip", "x", "food", 0, False),
        ("prioritize for the trip", "x", "food", 0, True), ("a solo traveller", "where is it safe", "food", 0, False), ("a solo traveller", "bars", "food", 0, True), ("Mid-range hotels", "hotels", "food", 0, True), ("Mid range hotels", "how much are hotels", "food", 0, False),
        ("Compare food", "x", "food", 2, True), ("Compare food", "x", "food", 0, False), ("Hue vs. Da Nang", "x", "food", 2, True), ("A day-by-day plan", "x", "itinerary", 0, True), ("A day-by-day plan", "x", "food", 0, False), ("plan for 3 days", "x", "itinerary", 0, True),
        ("nightlife to avoid", "x", "food", 0, True), ("nightlife", "x", "food", 0, False), (None, "x", "food", 0, False), ("", None, None, None, False),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, r string, q string, intent string, n int")
    got = {x["i"]: x["o"] for x in df.select("i", U.response_only(F.col("r"), F.col("q"), F.col("intent"), F.col("n")).alias("o")).collect()}
    assert {cases[i]: o for i, o in got.items()} == {c: c[4] for c in cases}


def test_phrases_are_whole_words_wherever_they_stand(spark):
    parts = itertools.product(("", "so ", "Well, "), ("how much", "price", "price-list", "priceless", "costly", "COST"), ("", "?", " of it", "s"))
    texts = ["".join(p) for p in parts]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.says(U.spoken(F.col("t")), U.PRICES)).collect()]
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    assert got == [any(w in ("cost", "price") for w in words(t)) or ("how", "much") in zip(words(t), words(t)[1:]) for t in texts]


def test_budgets_of_generated_sentences(spark):
    """A level counts if one mention has no negation up to five words before it: word by word."""
    r = random.Random(21)
    words = ["avoid", "not", "without", "no", "rather than", "cheap", "luxury", "mid-range", "moderate budget", "budget", "low cost", "high-end", "a", "hotel", "place,", "really", "old-town", "do not want", "nothing"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 14))) for _ in range(400)]

    def brute(text):
        out = []
        for level, pattern in U.BUDGETS.items():
            for m in re.finditer(rf"(?i)\b(?={pattern})(?=(?:{pattern})\b)", text):
                before = [text[n.end() : m.start()] for n in re.finditer(rf"(?i)\b(?:{U.NEGATIONS})", text[: m.start()])]
                if not any(re.fullmatch(r"(?:\s+\w+){0,5}\s*", gap) for gap in before):
                    out.append(level)
                    break
        return out

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", U.budgets(F.col("t")).alias("b")).collect()
    assert {x["i"]: sorted(x["b"]) for x in got} == {i: sorted(brute(t)) for i, t in enumerate(texts)}


def test_names_of_generated_sentences(spark):
    """Whole words in any case, not the start of a longer capitalised name."""
    r = random.Random(3)
    names = ["Hue", "Hoi An", "Da Nang", "An"]
    words = ["Hue", "hoi an", "Da Nang", "AN", "City", "city", "province", "Bay", "beach", "hues", "x", "and", "Market,"]
    texts = [r.choice(["", " "]).join([" ".join(r.choices(words, k=r.randint(1, 8))), r.choice(["", ".", "!"])]) for _ in range(300)]

    def says(text, name):
        for m in re.finditer(rf"(?i)(?<!\w){re.escape(name)}(?!\w)", text):
            after = re.match(r"\s+([^\s]+)", text[m.end() :])
            if not after or not re.match("[A-ZÀ-Ỹ]", after[1]) or re.match(r"(?i)(?:city|province)(?![\wÀ-ỹ'-])", after[1]):
                return True
        return False

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", U.explicit_names(F.col("t"), names).alias("n")).collect()
    assert {x["i"]: x["n"] for x in got} == {i: [n for n in names if says(t, n)] for i, t in enumerate(texts)}


def test_places_to_stay_become_areas(spark):
    cases = [
        ("Which accommodations are located near the beach", "where to stay", "Which", "which neighborhoods or base areas provide access to the beach"), ("Budget-friendly accommodation options in Hue", "x", "", "budget-friendly neighborhoods or base areas to stay in Hue"),
        ("good accommodation options", "x", "", "good neighborhoods or base areas to stay"), ("Affordable accommodation", "x", "", "budget-friendly neighborhoods or base areas"), ("budget hotels near the river; hotel near it", "x", "", "budget-friendly areas to stay near the river; budget-friendly areas to stay near it"),
        ("hotels near it", "Hotel names please", "", "hotels near it"), ("hotels near it", "a specific resort", "", "hotels near it"), ("hotels nearby", "x", "", "hotels nearby"), (None, "x", "", None), ("hotels near it", None, "", "budget-friendly areas to stay near it"),
    ]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _, _) in enumerate(cases)], "i int, t string, q string")
    got = {x["i"]: (x["a"], x["b"]) for x in df.select("i", U.area_level(F.col("t"), F.col("q"), F.lit(U.ACCOMMODATION)).alias("a"), U.area_level(F.col("t"), F.col("q"), F.lit("food")).alias("b")).collect()}
    assert got == {i: (want, t) for i, (t, _, _, want) in enumerate(cases)}


def test_plans_of_long_conversations_take_linear_work(spark, tmp_path):
    import time

    from quillspan.plans.understanding import plan_normalise

    turns = [(c, t, "user", "x") for c, n in ((0, 1200), (1, 3), (2, 30)) for t in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    got = {r.conv_id: (r.requirements.split("|"), json.loads(r.tasks)) for r in plan_normalise(spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    asks = lambda c, n: [PHRASES[(c * 7 + t) % len(PHRASES)] for t in range(n)]
    assert len(got) == 3 and all(len(r) <= 6 and len(t) <= 6 for r, t in got.values())
    assert [r for r in asks(0, 16) if r in got[0][0]] == got[0][0] and got[1][0] == [r for r in asks(1, 3) if r in got[1][0]]
    # The first turns stay tasks after the cities in front; their indexes are places among what stays.
    assert [t["query"] for t in got[1][1]] == asks(1, 3) and all(got[1][0][i] in asks(1, 3) for t in got[1][1] for i in t["indexes"])
