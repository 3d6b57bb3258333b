"""Cleaning of Markdown that came from PDF and HTML converters, as columns.

Lines and inline marks are put right by a scanner (functions/marks.py), in batches; picture blocks and repeated lines are
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import marks
from ..functions import text as T

# What picture blocks are marked by.
PICTURE_START = r"(?i)\s*\*{0,2}\s*-{2,}\s*start of picture text\s*-{2,}\s*\*{0,2}\s*"
PICTURE_END = r"(?i)\s*\*{0,2}\s*-{2,}\s*end of picture text\s*-{2,}\s*\*{0,2}\s*"
PICTURE_HEADING = "### Image OCR Text"


def each(change: Callable[[str], str], text: Column) -> Column:
    """A function of a text over a column, in batches; null stays null."""

    @F.pandas_udf(StringType())
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else change(t))

    return changed(text)


def picture_blocks(text: Column, keep: bool = True, least: int = 80, letters: float = 0.35, apart: bool = True) -> Column:
    """Text read from pictures, between its marks, stays if it is long enough and mostly letters; under a heading if apart.

    What is between a start and the next start or end is looked at; marks without their counterpart go, the text by them
    stays.
    """

    def shown(body: Column) -> Column:
        flat = T.collapsed(body)
        good = F.lit(keep) & (F.char_length(flat) >= least) & (T.letters_ratio(flat) >= letters)
        return F.when(good, F.concat(F.lit(f"\n\n{PICTURE_HEADING}\n\n" if apart else "\n\n"), body, F.lit("\n\n"))).otherwise("\n")

    def block(pieces: Column) -> Column:
        lines = F.filter(F.transform(F.split(pieces[0], "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")
        ended = F.concat(T.let(F.array_join(lines, "\n"), shown), F.get(pieces, F.lit(1)))
        return F.when(F.size(pieces) < 2, F.concat(F.lit("\n"), pieces[0])).otherwise(ended)

    parts = F.transform(F.split(text, PICTURE_START, -1), lambda part, i: F.when(i == 0, part).otherwise(T.let(F.split(part, PICTURE_END, 2), block)))
    return F.regexp_replace(F.array_join(parts, ""), f"(?m)^{PICTURE_END}$", "")


def without_repeated_lines(text: Column, most_chars: int = 80, times: int = 3) -> Column:
    """Lines of at most most_chars that stand times times and more go; headings and list items stay."""
    safe = lambda x: (x == "") | x.rlike(r"^(?:#|- |\d+\.)") | (F.char_length(x) > most_chars)

    def kept(s: Column) -> Column:
        return F.array_join(F.filter(s["lines"], lambda x: safe(F.btrim(x)) | ~F.array_contains(s["again"], F.btrim(x))), "\n")

    def marked(lines: Column) -> Column:
        again = T.let(F.array_sort(F.transform(lines, lambda x: F.btrim(x))), lambda bare: F.array_distinct(F.filter(bare, lambda x, i: x == F.get(bare, i + F.lit(times - 1)))))
        return T.let(F.struct(lines.alias("lines"), again.alias("again")), kept)

    return T.let(F.split(text, "\n", -1), marked)


def finished(text: Column) -> Column:
    """No empty headings, no blanks at the ends of lines, one blank line at most between others, none at the ends."""
    bare = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.rtrim(F.regexp_replace(x, r"\s+$", "")), "^#{1,6}$", ""))
    kept = T.let(bare, lambda lines: F.filter(lines, lambda x, i: (x != "") | (F.coalesce(F.get(lines, i - 1), F.lit("")) != "")))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+\z", "")


def cleaned(df: DataFrame, text: str) -> DataFrame:
    """df with its Markdown column without a converter's noise. A null text is empty."""
    lines = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    shown = df.withColumn(text, each(marks.opened, lines)).withColumn(text, picture_blocks(F.col(text)))
    return shown.withColumn(text, each(marks.scanned, F.col(text))).withColumn(text, finished(without_repeated_lines(F.col(text))))


def deduplicated_blocks(text: Column, prefix: int = 180) -> Column:
    """Blocks between blank lines, each once: an exact repeat goes, and one of over prefix characters whose start a kept
    block has, both in lower case, without links and marks; so does a block of marks alone. Headings stay. A dropped block
    keeps no other from staying.

    So of the blocks with one start (or, if short, one key) the first stays, and headings: they are found by one sort.
    """
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n", -1), lambda b: F.btrim(b, F.lit(" \t\n\r"))), lambda b: b != "")
    bare = lambda b: T.collapsed(F.regexp_replace(F.regexp_replace(F.lower(b), r"\[[^\]]+\]\([^)]+\)", ""), r"[^a-z0-9à-ỹ\s]", " "))

    def told(b: Column, i: Column) -> Column:
        long = lambda key: F.struct(F.when(F.char_length(key) > prefix, F.concat(F.lit("long "), F.substring(key, 1, prefix))).otherwise(F.concat(F.lit("short "), key)).alias("group"), i.alias("i"), (key != "").alias("says"), b.startswith("#").alias("heading"), b.alias("block"))
        return T.let(bare(b), long)

    def first_ones(sorted_: Column) -> Column:
        first = lambda x, i: (i == 0) | (F.get(sorted_, i - 1)["group"] != x["group"])
        stay = F.filter(sorted_, lambda x, i: x["says"] & (x["heading"] | first(x, i)))
        return F.transform(F.array_sort(F.transform(stay, lambda x: F.struct(x["i"].alias("i"), x["block"].alias("block")))), lambda x: x["block"])

    return F.array_join(T.let(F.array_sort(F.transform(blocks, told)), first_ones), "\n\n")
