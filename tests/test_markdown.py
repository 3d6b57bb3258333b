"""Markdown as converters leave it, cleaned: pieces in any order, and very long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspan.functions import marks
from quillspan.operators import markdown


PIECES = [
    ("##Title", "## Title"), ("###   **Bold title**", "### Bold title"), ("# Head of it**And more.**", "# Head of it\n\nAnd more."), ("**Fabulous Food**", "## Fabulous Food"), ("some __bold__ and *italic*, _both_", "some bold and italic, both"),
    ("see ![alt](http://a/b.png) here", "see here"), ("<div class='x'>inside</div> 3 < 4", "inside 3 < 4"), ("the bay.**Da Nang** Breezy beaches", "the bay.\n\n## Da Nang\n\nBreezy beaches"), ("12 Old Quarter", "12. Old Quarter"),
    ("3Name of it - and why", "3. Name of it - and why"), ("• first\n♦second\n-third", "- first\n- second\n- third"), ("a , b  c   d !", "a, b c d!"), ("a snake_case_name stays", "a snake_case_name stays"), ("~~gone~~ now", "gone now"),
    ("Café &amp; more &lt;3", "Café & more <3"), ("one<BR />two", "one\ntwo"), ("* ==> picture [2 x 3] <== *", ""), ("####", ""), ("2026 Vietnam guide", "2026 Vietnam guide"), ("unpaired ** mark", "unpaired ** mark"),
]


def test_markdown_of_any_pieces_is_that_of_each(spark):
    """Pieces between lines of plain text, in any order and number: the whole is cleaned as each alone is."""
    r = random.Random(4)
    texts, wanted = [], []
    for _ in range(150):
        chosen = r.sample(PIECES, k=r.randint(1, 12))
        texts.append("\n\n".join(f"{a}\n\nLine {i} (plain)" for i, (a, _) in enumerate(chosen)))
        wanted.append("\n\n".join(x for i, (_, b) in enumerate(chosen) for x in (b, f"Line {i} (plain)") if x))
    got = markdown.cleaned(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").collect()
    assert {x["i"]: x["t"] for x in got} == dict(enumerate(wanted))


@pytest.mark.parametrize("piece", ["**a _b <c [d ![e __f ~~g * h <br", "x**Aaa** b", "\n\n. ", "#", "1A - ", "**Abc def**\n", "a<b "])
def test_markdown_of_a_very_long_text_takes_linear_time(piece):
    took = []
    for size in (100_000, 1_000_000):
        text, began = piece * (size // len(piece)), time.process_time()
        marks.scanned(marks.opened(text))
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_blocks_of_any_text_are_those_of_one_pass(spark):
    """Kept blocks by their definition, one after the other, against the sort."""
    r = random.Random(8)
    long = "w" * 178

    def brute(text):
        out, keys, heads = [], set(), set()
        for block in (b.strip(" \t\r\n") for b in text.split("\n\n")):
            key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in block.lower()).split())
            again = key in keys or len(key) > 180 and key[:180] in heads
            if key and (block.startswith("#") or not again):
                out.append(block)
                keys.add(key)
                heads |= {key[:180]} if len(key) > 180 else set()
        return "\n\n".join(out)

    pieces = ["# A", "a", "A!", "b c", "***", "", f"{long} xyz", f"{long} xyz!", f"{long} xyw", f"# {long} xyz", f"{long} x", "#", "b\nc"]
    texts = ["\n\n".join(r.choices(pieces, k=r.randrange(14))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", markdown.deduplicated_blocks(F.col("t")).alias("t")).collect()
    assert {x["i"]: x["t"] for x in got} == {i: brute(t) for i, t in enumerate(texts)}
