"""Robots rules of sites, and which addresses they let an agent fetch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a file that are read, and characters of a rule.
MOST_LINES, MOST_RULE = 5000, 2000
RULES = "agent string, allow boolean, pattern string, size int"


def rules_of(text: str) -> list[tuple[str, bool, str, int]]:
    """(agent, allow, pattern, size) of a file's rules: agents in lower case, patterns as regular expressions of a path from
    its start, sizes as those of the rules as written. A rule belongs to the agents named before it; an empty one says
    nothing, so an agent with none but those has a rule that allows all."""
    out: list[tuple[str, bool, str, int]] = []
    agents: list[str] = []
    named = False  # was the line before a name? names in a row share what follows
    for line in text.replace("﻿", "").splitlines()[:MOST_LINES]:
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            agents = [*agents, value.lower()] if named else [value.lower()]
            named = True
            out += [(value.lower(), True, "^/", 0)]
        elif field in ("allow", "disallow"):
            named = False
            if value and len(value) <= MOST_RULE:
                out += [(a, field == "allow", pattern_of(value), len(value)) for a in agents]
    return out


def pattern_of(rule: str) -> str:
    """A rule's path as a regular expression: * is anything, $ at the end is the end."""
    end, path = rule.endswith("$"), unquote(rule.removesuffix("$"))
    return "^" + ".*".join(re.escape(part) for part in re.split(r"\*+", path)) + ("$" if end else "")


def robots_table(files: DataFrame, host: str, text: str) -> DataFrame:
    """(host, rules): an array of RULES for each host of a table of robots files; a null text is no file, an empty one has
    no rules and forbids nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("agent", pa.string()), ("allow", pa.bool_()), ("pattern", pa.string()), ("size", pa.int32())]))
        for batch in batches:
            held = [[dict(zip(("agent", "allow", "pattern", "size"), r, strict=True)) for r in rules_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, kind)], names=["host", "rules"])

    known = files.filter(F.col(text).isNotNull()).select(F.lower(host).alias("host"), text).dropDuplicates(["host"])
    return known.mapInArrow(work, "host string, rules array<struct<agent: string, allow: boolean, pattern: string, size: int>>")


def may_fetch(rules: Column, path: Column, agent: str) -> Column:
    """Do a host's rules let an agent fetch a path? The rules are those of the agent's own name, or else of *; the longest
    that fits decides, of equal ones the one that allows. Without a rule, yes; without a file, unknown (null)."""
    own = F.filter(rules, lambda r: r["agent"] == agent.lower())
    mine = F.when(F.size(own) > 0, own).otherwise(F.filter(rules, lambda r: r["agent"] == "*"))
    fits = F.filter(mine, lambda r: F.regexp_like(path, r["pattern"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return F.when(rules.isNotNull(), F.coalesce(best["allow"], F.lit(True)))


def with_robots(pages: DataFrame, url: str, robots: DataFrame, agent: str, to: str = "may_fetch") -> DataFrame:
    """pages with what the robots files (host, rules) of their hosts say of their addresses; a row for each page."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    decoded = F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), whole)
    known = robots.select(F.col("host").alias("__host"), F.col("rules").alias("__rules"))
    joined = pages.withColumn("__path", decoded).join(known, host == F.col("__host"), "left")
    return joined.select(*[c for c in pages.columns if c != to], may_fetch(F.col("__rules"), F.col("__path"), agent).alias(to))
