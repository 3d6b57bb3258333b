"""Names of large vocabularies in texts, and resumable calls of providers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import names as N
from quillspan.sources.ledger import Ledger

TEXT = "id long, text string"


def brute(text, names, whole):
    """All names as whole words by one search for each name; those within a longer one go."""
    hits = set()
    for name in names:
        words = re.findall(r"\w+|\W+", name.strip())
        pattern = "".join(r"\s+" if w.isspace() else re.escape(w) for w in words)
        for m in re.finditer(rf"(?i)(?=(?<!\w)({pattern})(?!\w))", text):
            after = re.match(r"\s+(\w+)", text[m.end(1) :])
            if whole and after and N._capital(after[1][0]) and after[1].lower() not in N.GENERIC:
                continue
            hits.add((m.start(1), m.end(1), N.key_of(name)))
    return sorted(h for h in hits if not any(a <= h[0] and h[1] <= b and (a, b) != h[:2] for a, b, _ in hits))


def found(spark, texts, names, whole=True):
    rows = N.find_names(spark.createDataFrame(texts, TEXT), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), "name", whole).collect()
    out = {i: [] for i, _ in texts}
    for r in rows:
        out[r.id].append((r.start, r.end, N.key_of(r["name"])))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("whole", [True, False])
def test_names_agree_with_brute_force(spark, whole):
    r = random.Random(6)
    words = ["hue", "hoi", "an", "da", "nang", "saint-louis", "l'isle", "ở", "Hue", "City", "province", "x1"]
    names = sorted({" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(60)})
    texts = [(i, "".join(r.choice(words) + r.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(r.randrange(30)))) for i in range(80)]
    texts = [(i, t.title() if i % 3 == 0 else t) for i, t in texts]
    assert found(spark, texts, names, whole) == {i: brute(t, names, whole) for i, t in texts}


def test_few_names_are_sent_to_the_texts_and_many_joined_alike(spark):
    r = random.Random(8)
    words = ["hue", "hoi", "an", "da", "l'isle", "City", "\u0130x", "x", "A\u03a3'A"]
    names = sorted({r.choice([" ", "\t", ", "]).join(r.choices(words, k=r.randint(1, 4))) for _ in range(40)})
    texts = [(i, "".join(r.choice(words) + r.choice([" ", "  ", ", ", "\n"]) for _ in range(r.randrange(40)))) for i in range(60)]
    for whole in (True, False):
        tables = [spark.createDataFrame(texts, TEXT), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), "name", whole]
        few, many = N.find_names(*tables), N.find_names(*tables, sent=len(names) // 2)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 100
        assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()


def test_the_longest_name_counts_and_edges_are_defined(spark):
    names = ["Hoi An", "hoi  an", "An", "An Bang Beach", "", "...", None]
    texts = [(1, "To Hoi An Bang Beach, hoi an."), (2, None), (3, ""), (4, "Hoi An City or Hoi An Bay"), (5, "an " * 40_000)]
    got = found(spark, texts, [n for n in names if n is not None])
    assert got[1] == [(7, 20, "an bang beach"), (22, 28, "hoi an")] and got[2] == got[3] == [] and got[4] == [(0, 6, "hoi an")]
    assert len(got[5]) == 40_000
    assert found(spark, texts[:1], []) == {1: []}


def test_a_million_names(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("place"), "id", F.when(F.col("id") % 3 == 0, F.lit(" old town")).otherwise("")).alias("name"))
    texts = [(i, " and ".join(f"Place{7 * i + j} Old town" for j in range(20))) for i in range(50)]
    got = N.find_names(spark.createDataFrame(texts, TEXT), "id", "text", names, "name", whole=False).collect()
    want = {(i, f"place{7 * i + j}" + (" old town" if (7 * i + j) % 3 == 0 else "")) for i in range(50) for j in range(20)}
    assert {(r.id, r["name"]) for r in got} == want and len(got) == 1000


def test_a_ledger_asks_nothing_twice_and_one_bad_input_costs_one_row(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory():
        def ask(inputs):
            (calls / f"{random.getrandbits(64):x}").write_text("\n".join(inputs))
            if any(x == "bad" for x in inputs):
                raise RuntimeError("no answer")
            return [x.upper() for x in inputs]

        return ask

    sent = lambda: sorted(x for f in calls.iterdir() for x in f.read_text().split("\n"))
    df = spark.createDataFrame([(i, f"text {i % 30}") for i in range(60)] + [(70, "bad"), (71, None), (72, "")], "id long, said string").coalesce(1)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = {r.id: (r.reply, r.reply_error) for r in ledger.ask(df, "said", "reply", factory, "m1").collect()}
    assert first[3] == ("TEXT 3", None) and first[33] == ("TEXT 3", None) and first[71] == (None, None) and first[72] == ("", None)
    assert first[70] == (None, "RuntimeError: no answer") and sum(o is not None for o, _ in first.values()) == 61
    bad = sum(x == "bad" for x in sent())
    assert bad <= 6 and len(set(sent())) == 32  # halved: as often as halves hold it
    n = len(list(calls.iterdir()))
    again = {r.id: (r.reply, r.reply_error) for r in ledger.ask(df, "said", "reply", factory, "m1").collect()}
    assert again == first and len(list(calls.iterdir())) == n
    more = df.unionByName(spark.createDataFrame([(90, "new")], "id long, said string"))
    assert {r.id: r.reply for r in ledger.ask(more, "said", "reply", factory, "m1").collect()}[90] == "NEW" and len(list(calls.iterdir())) == n + 1
    ledger.ask(df, "said", "reply", factory, "m1", again=True).collect()
    assert sum(x == "bad" for x in sent()) == bad + 1 and len(list(calls.iterdir())) == n + 2
    ledger.ask(df.filter("id < 5"), "said", "reply", factory, "m2").collect()
    assert len(list(calls.iterdir())) == n + 3
