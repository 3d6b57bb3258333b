"""Mixing sources to target weights.

Each source's documents, in a pseudorandom order, form one stream of words that is packed into blocks of fixed length.
Every output shard draws multinomial counts of blocks for each source; the slots of a source, numbered through the
shards, are mapped through pseudorandom permutations of its block indices, one permutation for each pass over the
source; blocks and slots are joined by index. All draws hang on a seed and on ids alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table, text_of

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Words in a block; slots in a shard, more where there would be over MAX_SHARDS.
BLOCK, SHARD, MAX_SHARDS, SEED = 128, 4096, 1 << 16, 20240
#: Documents of a slice of a source whose sizes one task sums, and the least number of slices; slots that one task makes.
SLICE_ROWS, SLICES, TASK_SLOTS = 1 << 18, 1024, 1 << 20
#: Blocks of a source that is taken in part: small sources have shorter blocks.
LEAST_BLOCKS = 64


class Plan(NamedTuple):
    source: list[str | None]
    size: list[int]
    target: list[float]


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of share times all sizes by weight, repeating; none above cap times its size, the excess reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = total / sum(w[i] for i in open_)
        full = {i for i in open_ if unit * w[i] > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            total -= out[i]
        open_ -= full
    return out


def plan(sized: DataFrame) -> Plan:
    """Targets from the sizes of sources: one row for each source comes to the driver, no document."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    # By code point: UTF-8 bytes sort alike. Null last.
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    return Plan([r.source for r in rows], [int(r["size"]) for r in rows], targets([int(r["size"]) for r in rows]))


def shares(p: Plan, block: int = BLOCK) -> tuple[list[int], list[int], list[int]]:
    """Of each source: words in its blocks, how many blocks it has, and its quota, the target in blocks of their mean size.

    A source that is taken whole as often as may be needs no other blocks than the rest, however small it is.
    """
    length = [block if t >= CAP * s - 1e-9 else max(1, min(block, s // LEAST_BLOCKS)) for s, t in zip(p.size, p.target, strict=True)]
    blocks = [-(-s // n) for s, n in zip(p.size, length, strict=True)]
    quota = [min(CAP * n, round(t * n / max(1, s))) for s, t, n in zip(p.size, p.target, blocks, strict=True)]
    return length, blocks, quota


def source_table(spark: SparkSession, p: Plan, block: int = BLOCK) -> DataFrame:
    """(__source, name, source_size, target, length, quota): a row for each source, joined where needed, however many there are."""
    length, _, quota = shares(p, block)
    columns = [pa.array(range(len(p.source)), pa.int32()), pa.array(p.source, pa.string()), pa.array(p.size, pa.int64()), pa.array(p.target, pa.float64()), pa.array(length, pa.int64()), pa.array(quota, pa.int64())]
    return spark.createDataFrame(pa.table(columns, names=["__source", "name", "source_size", "target", "length", "quota"]))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network on the least even number of bits, walked on
    until it falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            k = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
            h = (b + k) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo &= out >= n
    return out.astype(np.int64)


def slices_of(rows: int) -> int:
    """Slices of each source, were all rows of one: a power of two."""
    return max(SLICES, 1 << (-(-rows // SLICE_ROWS)).bit_length())


def stream_positions(sized: DataFrame, slices: int = SLICES) -> DataFrame:
    """sized with __start, the document's first word in its source's stream, and __order, its place there.

    The order is that of a hash of the id, ties by id, size and text. Sums run within slices of the hash's range, the
    slices' totals over a table of slices, so no source is summed in one task.
    """
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 40))
    cut = sized.withColumn("__h", h).withColumn("__slice", F.floor(F.col("__h") / ((1 << 40) // slices)).cast("int"))
    totals = cut.groupBy("source", "__slice").agg(F.sum("size").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("source").alias("__s"), F.col("__slice").alias("__c"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to) for c, to in (("__sum", "__base"), ("__n", "__rows"))])
    own = Window.partitionBy("source", "__slice").orderBy("__h", "doc_id", "size", "__text")
    run = cut.withColumn("__in", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__r", F.row_number().over(own))
    joined = run.join(base, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__c")))
    return joined.withColumn("__start", F.col("__in") + F.col("__base")).withColumn("__order", F.col("__r") + F.col("__rows")).drop("__s", "__c", "__h", "__in", "__r", "__base", "__rows", "__slice")


def draw_slots(spark: SparkSession, p: Plan, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, slot, __source index, block): what each output slot takes.

    Each shard's counts are a multinomial draw by target. A source's draws are then cut or topped up, at the last
    shards, to its quota, so that chance moves no source off its target.
    """
    _, blocks, quota = shares(p, block)
    total = sum(quota)
    shard = max(shard, -(-total // MAX_SHARDS))
    shards = max(1, -(-total // shard))
    odds = np.array(quota, float) / max(1, total)
    n_sources = len(quota)

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [np.random.default_rng((seed, int(i))).multinomial(min(shard, total - int(i) * shard), odds) for i in f["id"]]
            yield pd.DataFrame({"shard": np.repeat(f["id"].to_numpy(), n_sources), "__source": np.tile(np.arange(n_sources), len(f)), "n": np.concatenate(made) if made else []})

    drawn = spark.range(shards if total else 0).mapInPandas(counts, "shard long, __source int, n long")
    # Slots of a source are numbered through the shards: a running sum over one row for each shard.
    before = Window.partitionBy("__source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")
    end = F.when(F.col("shard") == shards - 1, F.col("quota")).otherwise(F.least(F.col("first") + F.col("n"), F.col("quota")))
    ranges = drawn.withColumn("first", first).join(source_table(spark, p, block).select("__source", "quota"), "__source").withColumn("end", end).filter("end > first")
    # Wide ranges are dealt out before they become slots.
    cut = "transform(sequence(first, end - 1, 4096L), x -> named_struct('a', x, 'b', least(x + 4096L, end)))"
    pieces = ranges.select("shard", "__source", F.explode(F.expr(cut)).alias("r"))

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s, i, a, b in zip(f["shard"], f["__source"], f["a"], f["b"], strict=True):
                j = np.arange(a, b)
                taken = np.empty(len(j), np.int64)
                for turn in np.unique(j // blocks[i]):
                    on = j // blocks[i] == turn
                    taken[on] = permuted(j[on] % blocks[i], blocks[i], seed + 1_000_003 * int(i) + int(turn))
                yield pd.DataFrame({"shard": s, "slot": j, "__source": i, "block": taken})

    # A number of tasks is named: a row is small, but up to 4,096 slots come of it.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SLOTS))
    dealt = pieces.select("shard", "__source", "r.a", "r.b").repartition(tasks, "shard", "__source", "a")
    return dealt.mapInPandas(slots, "shard long, slot long, __source int, block long")


class Mix(NamedTuple):
    plan: Plan
    slots: DataFrame  # shard, slot, __source, block
    pieces: DataFrame  # __source, block, document row, words of it in the block
    documents: DataFrame


def block_spans() -> tuple[Column, Column]:
    """The blocks that a document has words in; of one of them (block), how many."""
    last = F.col("__start") + F.col("size") - 1
    end = F.least((F.col("block") + 1) * F.col("__length"), F.col("__start") + F.col("size"))
    at = F.sequence(F.floor(F.col("__start") / F.col("__length")), F.floor(last / F.col("__length")))
    return at, end - F.greatest(F.col("block") * F.col("__length"), F.col("__start"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """The whole mix: the plan, what each slot takes, and which words of which documents make up each block.

    docs need doc_id, text and source; other columns are not looked at. Null and empty texts have no words and are in no
    block. A null source is a source, the last. Repeated rows are documents of their own. An empty table, or one without
    words, gives no slots.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(text_of()).alias("__text")), "sizes")
    p = plan(sized)
    names = source_table(spark, p, block).select("__source", F.col("name").alias("__name"), F.col("length").alias("__length"))
    placed = sized.join(names, F.col("source").eqNullSafe(F.col("__name"))).drop("__name")
    rows = materialize(stream_positions(placed, slices_of(sized.count())), "positions")
    at, words = block_spans()
    pieces = rows.filter("size > 0").select("__source", "__order", "__start", "size", "__length", F.explode(at).alias("block"))
    return Mix(p, draw_slots(spark, p, block, shard, seed), pieces.select("__source", "__order", "block", words.alias("words")), rows)


def mixed_blocks(docs: DataFrame, m: Mix) -> DataFrame:
    """The mixture: (shard, slot, source, block, text), a row for each slot. docs: those of m.

    A block's text is its words, a space between two. Repeated rows are equal texts, so any of them takes any's place.
    """
    same = Window.partitionBy("doc_id", "source", "__text").orderBy(F.lit(1))
    held = docs.select("doc_id", "source", text_of().alias("text")).withColumn("__text", F.xxhash64("text"))
    held = held.filter(word_count(F.col("text")) > 0).withColumn("k", F.row_number().over(same))
    held = held.select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("__text").alias("__t"), F.col("k").alias("__k"), "text")
    placed = m.documents.filter("size > 0").withColumn("k", F.row_number().over(same))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__text") == F.col("__t")) & (F.col("k") == F.col("__k"))
    at, words = block_spans()
    tokens = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = placed.join(held, on).withColumn("w", tokens).select("__source", "__order", "__start", "size", "__length", "w", F.explode(at).alias("block"))
    first = F.greatest(F.col("block") * F.col("__length"), F.col("__start")) - F.col("__start") + 1
    parts = cut.select("__source", "block", F.struct("__order", F.array_join(F.slice("w", first.cast("int"), words.cast("int")), " ").alias("text")).alias("part"))
    texts = parts.groupBy("__source", "block").agg(F.array_join(F.sort_array(F.collect_list("part"))["text"], " ").alias("text"))
    names = source_table(docs.sparkSession, m.plan).select("__source", F.col("name").alias("source"))
    return m.slots.join(texts.hint("merge"), ["__source", "block"]).join(names, "__source").select("shard", "slot", "source", "block", "text")


def write_shards(docs: DataFrame, m: Mix, path: str) -> None:
    """The mixture as Parquet, a folder for each shard, its sources' slots mixed by hash."""
    rows = mixed_blocks(docs, m).repartition("shard")
    rows.sortWithinPartitions("shard", F.xxhash64("source", "slot", F.lit(SEED))).write.partitionBy("shard").parquet(path)


def taken_words(m: Mix) -> DataFrame:
    """doc_id, source, size and taken, the words of the document in the mix, for every document."""
    uses = m.slots.groupBy("__source", "block").agg(F.count(F.lit(1)).alias("uses"))
    # Slots come from a range of shards, whose estimated size says nothing of theirs: no side may be broadcast for it.
    sums = m.pieces.join(uses.hint("merge"), ["__source", "block"]).groupBy("__source", "__order").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return m.documents.join(sums.hint("merge"), ["__source", "__order"], "left").select("doc_id", "source", "__source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (its source's) and taken."""
    m = mix(docs)
    shares = source_table(docs.sparkSession, m.plan).select("__source", "source_size", "target")
    return taken_words(m).join(shares, "__source").select("doc_id", "size", "source_size", "target", "taken")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document: what it gives to the mixture. Edge cases as in mix."""
    return mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
