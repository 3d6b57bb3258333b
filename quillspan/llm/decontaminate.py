"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct shingles. An item of q shingles that a document contains to a share of
at least t lacks at most (1 - t) q of them, so the document holds one of the item's floor((1 - t) q) + 1 least hashes at
least. Those least hashes are the item's MinHash signature, of one length for each size partition, looked up one by one
(bands of one row: a short item's likeness to a long document is next to nothing, and longer bands would miss it). It is
a prefix filter: the document's side has no signature, each of its shingles is looked up, and no item is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, as_rows, free_name, map_texts, materialize, own, shingle_hashes, slim_batches, table, text_of, word_hashes, words_of

SHINGLE, CONTAINMENT = 5, 0.8
#: Words (or shingles of longer items) that are searched for in one pass over the documents: the bound of what is sent to
#: executors.
BLOCK_WORDS = 1 << 19
_TABLE_BITS = 22


class Item(NamedTuple):
    item_id: int | None
    shingles: frozenset  # exact


class Index(NamedTuple):
    items: list[Item]
    keys: np.ndarray  # sorted signature hashes
    owners: list[list[int]]  # items of each key
    filter: np.ndarray  # bits of the keys, to pass by most shingles
    short: dict[int, dict[bytes, list[int]]]  # items of fewer words than a shingle: by their number, the whole sequence


def size_partition(q: int) -> int:
    """Partition p holds items of 2^p to 2^(p+1) - 1 shingles."""
    return q.bit_length() - 1


def signature_length(p: int, t: float = CONTAINMENT) -> int:
    """Enough for the largest item of partition p."""
    return int(np.floor((1 - t) * ((2 << p) - 1) + 1e-9)) + 1


def runs_of(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def build_index(rows: list[tuple[int | None, str | None]], t: float = CONTAINMENT, n: int = SHINGLE) -> Index:
    """Items of fewer than n words are one shingle, the whole sequence; items without words are never found."""
    items, owners, short = [], {}, {}
    for item_id, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        if len(words) < n:
            short.setdefault(len(words), {}).setdefault(b" ".join(words), []).append(len(items))
        else:
            hashes = np.unique(shingle_hashes(word_hashes(words), n))
            for h in hashes[: signature_length(size_partition(len(hashes)), t)].tolist():
                owners.setdefault(h, []).append(len(items))
        items.append(Item(item_id, frozenset(runs_of(words, min(n, len(words))))))
    keys = np.array(sorted(owners), np.uint64)
    bits = np.zeros(1 << _TABLE_BITS, bool)
    bits[keys >> np.uint64(64 - _TABLE_BITS)] = True
    return Index(items, keys, [owners[k] for k in keys.tolist()], bits, short)


def hits_of(text: str, index: Index, t: float = CONTAINMENT, n: int = SHINGLE) -> list[dict]:
    """Items that a text contains: item_id, n_shingles, n_shared, containment, in the order of the items."""
    words = words_of(text)
    found = [(i, 1) for m, known in index.short.items() for run in runs_of(words, m) for i in known.get(run, ())]
    hashes = shingle_hashes(word_hashes(words), n) if len(words) >= n else np.zeros(0, np.uint64)
    hashes = hashes[index.filter[hashes >> np.uint64(64 - _TABLE_BITS)]]
    if len(hashes) and len(index.keys):
        at = np.minimum(np.searchsorted(index.keys, hashes), len(index.keys) - 1)
        candidates = {i for k in np.unique(at[index.keys[at] == hashes]).tolist() for i in index.owners[k]}
        held = runs_of(words, n) if candidates else set()
        found += [(i, len(index.items[i].shingles & held)) for i in candidates]
    out = []
    for i, shared in sorted(found):
        item = index.items[i]
        if shared >= t * len(item.shingles):
            out.append({"item_id": item.item_id, "n_shingles": len(item.shingles), "n_shared": shared, "containment": shared / len(item.shingles)})
    return out


SCHEMA = "array<struct<item_id: bigint, n_shingles: bigint, n_shared: bigint, containment: double>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())]))
_PARTS = "array<struct<at: bigint, n_shared: bigint>>"
_PART_HITS = pa.list_(pa.struct([("at", pa.int64()), ("n_shared", pa.int64())]))


def search(docs: DataFrame, index: Index, to: str, keep: list[str]) -> DataFrame:
    """docs with the items of one index, which goes to the tasks."""
    return map_texts(docs, lambda texts: [pa.array([hits_of(t, index) for t in texts], _HITS)], {to: (SCHEMA, _HITS)}, keep=keep)


def text_keys() -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {"h1": F.xxhash64(text_of()), "h2": F.xxhash64(F.lit("second"), text_of())}


def by_blocks(docs: DataFrame, items: DataFrame, blocks: int) -> list[DataFrame]:
    """(h1, h2, hits) of the texts that contain items, a table for each block of items: each its own pass over the texts."""
    out = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        index = build_index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        found = search(docs, index, "hits", ["h1", "h2"]).filter(F.size("hits") > 0)
        out.append(materialize(found.dropDuplicates(["h1", "h2"]), "hits"))
    return out


def item_shingles(items: DataFrame) -> DataFrame:
    """(at, shingle) of items (at, text) of SHINGLE words and more: their distinct shingles, as a table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches):
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for i in range(0, len(words) - SHINGLE + 1, 1 << 16):
                    runs = runs_of(words[i : i + (1 << 16) + SHINGLE - 1], SHINGLE)
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(runs), pa.int64()), pa.array(runs, pa.binary())], names=["at", "shingle"])

    return materialize(items.select("at", "text").mapInArrow(work, "at long, shingle binary").distinct(), "shingles")


def shared_by(text: str, parts: dict[bytes, list[int]]) -> list[dict]:
    """How many shingles of each part of an item a text has; parts it has none of are left out."""
    count: dict[int, int] = {}
    for run in runs_of(words_of(text), SHINGLE):
        for at in parts.get(run, ()):
            count[at] = count.get(at, 0) + 1
    return [{"at": at, "n_shared": n} for at, n in sorted(count.items())]


def long_items(docs: DataFrame, items: DataFrame, block: int) -> list[DataFrame]:
    """(h1, h2, hits) of the texts that contain items longer than a block: these are cut into parts of their shingles, a
    pass for each, and what a text shares with the parts is summed up."""
    numbered = materialize(items.withColumn("at", F.monotonically_increasing_id()), "long")
    shingles = item_shingles(numbered)
    sizes = shingles.groupBy("at").agg(F.count(F.lit(1)).alias("n_shingles"))
    passes, counts = max(1, -(-shingles.count() // block)), []
    for b in range(passes):
        own: dict[bytes, list[int]] = {}
        for r in shingles.filter(F.pmod(F.xxhash64("shingle"), F.lit(passes)) == b).collect():
            own.setdefault(bytes(r["shingle"]), []).append(r["at"])

        def count(texts: list[str], own: dict = own) -> list[pa.Array]:
            return [pa.array([shared_by(t, own) for t in texts], _PART_HITS)]

        found = map_texts(docs, count, {"parts": (_PARTS, _PART_HITS)}, keep=["h1", "h2"]).filter(F.size("parts") > 0)
        counts.append(materialize(found.dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode("parts").alias("p")).select("h1", "h2", "p.*"), "parts"))
    whole = reduce(DataFrame.unionByName, counts).groupBy("h1", "h2", "at").agg(F.sum("n_shared").alias("n_shared")).join(sizes, "at")
    held = whole.filter(F.col("n_shared") >= CONTAINMENT * F.col("n_shingles")).join(numbered.select("at", "item_id"), "at")
    hit = F.struct("item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    return [held.select("h1", "h2", F.array(hit).alias("hits"))]


def find_items(docs: DataFrame, items: DataFrame, to: str = "hits", keep: list[str] | None = None, block: int = BLOCK_WORDS) -> DataFrame:
    """docs with the benchmark items (item_id, text) that each document's text contains, as an array.

    Shingles are five words, A-Z lower-cased; an item is found when at least CONTAINMENT of its distinct shingles are in
    the document. An item of fewer words is one shingle, looked for among the document's runs of as many words. Null and
    empty texts contain nothing, items without words are never found, repeated items are found once each, repeated
    documents alike. A column of the name of the result gives way; keep names the columns to return, all by default.
    Items of more than so many words go to the executors in blocks: a pass over the documents for each, which writes the
    texts that contain something; an item longer than a block goes in parts. No task holds more than a block.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != to.lower()]
    size = F.regexp_count(text_of(), F.lit(WORD))
    numbered = materialize(items.select("item_id", "text").distinct().withColumn("words", size), "items")
    words = numbered.agg(F.sum("words")).first()[0] or 0
    if words <= block:
        rows = sorted(((r["item_id"], r["text"]) for r in numbered.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        return search(docs, build_index(rows), to, kept)
    texts = docs.select("text").select(*[c.alias(k) for k, c in text_keys().items()], "text")
    usual, long = numbered.filter(F.col("words") <= block), numbered.filter(F.col("words") > block)
    total = usual.agg(F.sum("words")).first()[0] or 0
    found = by_blocks(texts, usual, max(1, -(-total // block)))
    if not long.isEmpty():
        found += long_items(texts, long, block)
    hits = reduce(DataFrame.unionByName, found).groupBy(F.col("h1").alias("s1"), F.col("h2").alias("s2")).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    hits = materialize(hits, "found")  # of a known size: a small one is broadcast
    held = as_rows(docs.select(*[own(c) for c in dict.fromkeys([*kept, "text"])]), **text_keys()).join(hits, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left")
    columns = [F.col("row").getField(c).alias(c) for c in kept]
    return held.select(*columns, F.coalesce("hits", F.array().cast(SCHEMA)).alias(to))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs that contain no benchmark item; columns as they are."""
    hits = free_name(docs, "hits")
    found = find_items(docs, items, hits)
    return found.filter(F.size(hits) == 0).select(*[own(c) for c in docs.columns])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains."""
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


_WORDS = f"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _sql_runs(relation: str, key: str, n: str) -> str:
    return f"SELECT DISTINCT {key}, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g FROM (SELECT *, {n} AS n FROM {relation}) WHERE len(ws) >= n"


ORACLE = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents), bw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
b AS ({_sql_runs("(SELECT * FROM bw WHERE len(ws) > 0)", "item_id", f"least(len(ws), {SHINGLE})")}),
lengths AS (SELECT DISTINCT n AS wanted FROM b), d AS ({_sql_runs("(SELECT * FROM dw, lengths)", "doc_id", "wanted")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (n, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM s JOIN n USING (item_id) WHERE n_shared >= {CONTAINMENT} * n_shingles
"""
