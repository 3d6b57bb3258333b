"""Cleaning, splitting and dedup of text within and across documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


def word_windows(text: Column, size: int = 180, overlap: int = 40) -> Column:
    """Windows of words, each overlap words over the next; the last reaches the end of the text."""
    words = T.tokens(text)
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)).cast("int") * (size - overlap)), F.lit(size - overlap))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " ")))


def header_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, h1, h2, h3, h4, body): text split at headings of level 1 to 4, each with the headings above it."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    level = F.char_length(F.regexp_extract("line", r"^(#{1,4})\s+\S", 1))
    title = F.trim(F.regexp_extract("line", r"^#{1,4}\s+(.*)$", 1))
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("level", level).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    for i in range(1, 5):
        # A heading of a higher level resets the lower ones.
        value = F.when(F.col("level") == i, title).when((F.col("level") > 0) & (F.col("level") < i), F.lit(""))
        marked = marked.withColumn(f"h{i}", F.nullif(F.last(value, ignorenulls=True).over(w), F.lit("")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy(key, "section").agg(*[F.max(f"h{i}").alias(f"h{i}") for i in range(1, 5)], body.alias("body"))


def with_heading_context(sections: DataFrame) -> DataFrame:
    """A section's text led by its headings, and the deepest of them."""
    path = F.concat_ws(" > ", "h1", "h2", "h3", "h4")
    led = F.when(path == "", F.col("body")).otherwise(F.concat(F.lit("Section: "), path, F.lit("\n\n"), F.col("body")))
    return sections.withColumn("chunk_text", led).withColumn("section_heading", F.coalesce("h4", "h3", "h2", "h1"))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters that break at the coarsest separator they can, with overlap between them."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p for p in (x if i == 0 else sep + x for i, x in enumerate(text.split(sep))) if p]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if len(part) > size:
            if held:
                out.append("".join(held).strip())
            out += split_recursively(part, size, overlap, rest) if rest else [part]
            held, length = [], 0
            continue
        if length + len(part) > size and held:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def chunked(df: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(key, chunk_index, chunk_text): one row to many, batch by batch."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f[key], f[text], strict=True) for i, c in enumerate(split_recursively(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk_text"])

    return df.select(key, text).mapInPandas(split, f"{key} long, chunk_index int, chunk_text string")


def merge_short(df: DataFrame, by: str, order: str, text: str, section: str | None = None, least: int = 150, most: int = 1200, noise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(by, position, text): pieces of under least characters join the next one of their section, else the one before, up to
    most; what can join neither stays, unless it is noise. Empty pieces go.

    A fold over each document's pieces, in order: the last one is undecided until the next is seen.
    """
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\r"))
    head = F.coalesce(F.col(section).cast("string"), F.lit("")) if section else F.lit("")
    pieces = F.transform(F.sort_array(F.collect_list(F.when(body != "", F.struct(F.col(order).alias("at"), head.alias("s"), body.alias("t"))))), lambda x: F.struct(x["s"].alias("s"), x["t"].alias("t")))
    empty = F.array().cast("array<struct<s:string,t:string>>")

    def fits(a: Column, b: Column) -> Column:
        return (a["s"] == b["s"]) & (F.char_length(a["t"]) + F.char_length(b["t"]) + 2 <= most)

    def both(a: Column, b: Column) -> Column:
        return F.array(F.struct(a["s"].alias("s"), F.concat(a["t"], F.lit("\n\n"), b["t"]).alias("t")))

    def decided(acc: Column) -> Column:
        n, last, before = F.size(acc), F.try_element_at(acc, F.lit(-1)), F.try_element_at(acc, F.lit(-2))
        short = (n > 0) & (F.char_length(last["t"]) < least)
        left = F.when(noise(last["t"]), F.slice(acc, 1, n - 1)).otherwise(acc) if noise else acc
        return F.when(short & (n > 1) & fits(before, last), F.concat(F.slice(acc, 1, n - 2), both(before, last))).when(short, left).otherwise(acc)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        forward = (F.size(acc) > 0) & (F.char_length(last["t"]) < least) & fits(last, x)
        return F.when(forward, F.concat(F.slice(acc, 1, F.size(acc) - 1), both(last, x))).otherwise(F.concat(decided(acc), F.array(x)))

    merged = F.transform(F.aggregate(pieces, empty, step, decided), lambda x: x["t"])
    return df.groupBy(by).agg(merged.alias("m")).select(by, F.posexplode("m").alias("position", text))


# The limits of an enrichment.
LIMITS = {"tags": 8, "activities": 8, "styles": 4, "suitable_for": 4}
LABEL_CHARS, SUMMARY_CHARS, REASON_CHARS = 40, 300, 250


def limited_metadata(summary: Column, reasoning: Column, confidence: Column, **lists: Column) -> Column:
    """A struct of an enrichment within its limits: lists by name, labels cut, a confidence from 0 to 1."""
    short = [F.transform(F.slice(v, 1, LIMITS[k]), lambda t: F.substring(t, 1, LABEL_CHARS)).alias(k) for k, v in lists.items()]
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.struct(*short, F.substring(summary, 1, SUMMARY_CHARS).alias("summary"), F.substring(reasoning, 1, REASON_CHARS).alias("reasoning"), sure.alias("confidence"))


def fallback_metadata(text: Column, reason: Column, country: str) -> Column:
    """What stands in for an enrichment that failed."""
    none = F.array().cast("array<string>")
    made = limited_metadata(text, reason, F.lit(0.0), **dict.fromkeys(LIMITS, none))
    return F.struct(F.lit(country).alias("country"), *[made[k].alias(k) for k in (*LIMITS, "summary", "reasoning", "confidence")])
