"""Near-dedup of texts: candidates are verified by exact shingle sets, one document of each group stays.

Exact copies are one text, by 128 bits. Candidate pairs come from two searches, and all are verified in the same way:

1. Early ones, fewer than a fixed number for each text, that connect a group of very many near copies: by SimHash and the
   generalised pigeonhole principle, as in simhash.py, over fingerprints of word pairs; and each text with the next
   larger one that has one of its least shingle hashes.
2. A prefix-filter join of all distinct texts on the rarest shingles of each. Two texts of the likeness share one of
   them, whatever the edits between them; pairs that are connected already are left out. So no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import as_rows, map_texts, materialize, shingle_hashes, slim_batches, text_of, word_hashes, words_of
from .components import connected

#: Words in a shingle and the least likeness of near-duplicates.
SHINGLE, LIKENESS = 5, 0.8
#: Words in a fingerprint's feature; bits in which a pair's fingerprints may differ to be verified early.
FEATURE, TAU = 2, 4
#: Least hashes of a text by which it meets its neighbours early.
LEAST = 8
#: Shingles are counted in 2^this buckets, over all texts: the order of rareness.
BUCKET_BITS = 18
#: Texts and shingles on each side of a task's comparisons.
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 1 << 22
#: Rows of a shingle that are paired as they come; more are told apart by bitmaps of so many bits, in blocks of so many rows.
RUN_ROWS, BITMAP, CELL_ROWS = 8, 1024, 1024
#: Texts of more shingles have a bitmap of about a bit for each as well, of so many bits at most.
WIDE, MOST_BITS = 2048, 1 << 16
#: Bits of the table by which texts that no pair asks for are passed over when the others are fetched.
ASKED_BITS = 24


def shingle_set(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z lower-cased; of the whole sequence if it has fewer words."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), n))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each bucket: a fixed number of counts, whatever the table's size.

    A shingle that very many texts share stands out of its bucket's noise. Any order of shingles that all texts share
    finds all pairs; rarest first makes fewer others.
    """
    shift, size = np.uint64(64 - BUCKET_BITS), 1 << BUCKET_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slim_batches(batches):
            sets = [shingle_set(t or "") >> shift for t in batch.column(0).to_pylist()]
            total += np.bincount(np.concatenate(sets).astype(np.int64), minlength=size)
        on = np.flatnonzero(total)
        for i in range(0, len(on), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(on[i : i + (1 << 16)], pa.int32()), pa.array(total[on[i : i + (1 << 16)]])], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return np.unique(out, return_inverse=True)[1].astype(np.uint32)


def prefix_of(shingles: np.ndarray, order: np.ndarray) -> bytes:
    """The rarest shingles, in order: a set of the likeness has one of them among its own. Of no shingles: a key 0."""
    if not len(shingles):
        return bytes(8)
    wanted = len(shingles) - int(np.ceil(LIKENESS * len(shingles) - 1e-9)) + 1
    rank = order[shingles >> np.uint64(64 - BUCKET_BITS)]
    return shingles[np.argsort(rank, kind="stable")[:wanted]].astype("<u8").tobytes()


def bitmap_of(shingles: np.ndarray, bits: int = BITMAP) -> bytes:
    """A bit for each remainder of the hashes: is it that of an odd number of shingles? Two bitmaps differ in at most as
    many bits as the sets differ in shingles, so they bound what the sets can have in common."""
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def wide_bitmap_of(shingles: np.ndarray) -> bytes | None:
    """A long text fills the common bitmap, which then tells it from nothing; its own has more bits, a power of two."""
    return bitmap_of(shingles, min(MOST_BITS, 1 << (len(shingles) - 1).bit_length())) if len(shingles) > WIDE else None


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two wide bitmaps differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def distinct_texts(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """h1, h2, node (a number), least (doc_id), fp, size (distinct shingles), prefix, least_hashes, bitmap and wide (bitmap
    of a long text) of each distinct text."""

    def mark(texts: list[str]) -> list[pa.Array]:
        fp, size, prefix, least, bits, wide = [], [], [], [], [], []
        for t in texts:
            hashed = word_hashes(words_of(t))
            pairs, shingles = shingle_hashes(hashed, FEATURE), np.unique(shingle_hashes(hashed, SHINGLE))
            fp.append(simhash.majority(simhash.bit_sums(pairs), len(pairs)))
            size.append(len(shingles))
            prefix.append(prefix_of(shingles, order))
            least.append(shingles[:LEAST].view(np.int64).tolist())
            bits.append(bitmap_of(shingles))
            wide.append(wide_bitmap_of(shingles))
        return [pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())]

    rows = docs.select("doc_id", *text_key(text_of()), F.col("text").alias("text"))
    made = {"fp": ("long", pa.int64()), "size": ("long", pa.int64()), "prefix": ("binary", pa.binary()), "least_hashes": ("array<long>", pa.list_(pa.int64())), "bitmap": ("binary", pa.binary()), "wide": ("binary", pa.binary())}
    marked = map_texts(rows, mark, made, keep=["doc_id", "h1", "h2"])
    firsts = [F.first(c).alias(c) for c in made]
    texts = marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), *firsts)
    return materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")


# ---- candidates

def near_by_fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns fp, size: are the texts worth an early comparison?"""
    small, large = np.minimum(a[..., 1], b[..., 1]), np.maximum(a[..., 1], b[..., 1])
    return (np.bitwise_count((a[..., 0] ^ b[..., 0]).view(np.uint64)) <= TAU) & (small >= LIKENESS * large - 1e-9)


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(key, u, v): of texts with near fingerprints, enough pairs to connect each key's rows. texts: node, fp, size."""
    layout = simhash.choose_layout(texts.select("fp").distinct(), texts.count(), TAU)
    dealt = simhash.deal_hot_keys(simhash.probe_rows(texts.select("fp", "size", "node"), layout), layout, TAU)
    return simhash.verified_links(dealt, near_by_fingerprint, "node").select(F.col("u").alias("key"), "u", "v")


def neighbour_pairs(texts: DataFrame) -> DataFrame:
    """(key, u, v): texts that have one of their least hashes in common and follow one another by size, of equal size by
    a hash. One pair a row at most: sorted ranges stream by, however many texts have a hash. texts: node, size, least_hashes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, 3), np.int64)
        for batch in batches:
            x = np.concatenate([last, np.column_stack([batch.column(i).to_numpy() for i in range(3)])])
            a, b = x[:-1], x[1:]
            on = (a[:, 0] == b[:, 0]) & (a[:, 2] != b[:, 2]) & (a[:, 1] >= LIKENESS * b[:, 1] - 1e-9)
            u, v = np.minimum(a[on, 2], b[on, 2]), np.maximum(a[on, 2], b[on, 2])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(u), pa.array(v)], names=["key", "u", "v"])
            last = x[-1:]

    rows = texts.select(F.explode("least_hashes").alias("hash"), "size", "node").withColumn("tie", F.xxhash64("node", "hash"))
    runs = rows.repartitionByRange("hash", "size", "tie").sortWithinPartitions("hash", "size", "tie")
    return runs.select("hash", "size", "node").mapInArrow(work, "key long, u long, v long")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns node, root, size, place of the shared shingle: are the texts not connected yet, and may they be alike?"""
    small, large = np.minimum(a[..., 2], b[..., 2]), np.maximum(a[..., 2], b[..., 2])
    both = np.minimum(a[..., 3], b[..., 3]) + np.minimum(a[..., 2] - a[..., 3], b[..., 2] - b[..., 3])
    least = LIKENESS / (1 + LIKENESS) * (small + large)
    return (a[..., 1] != b[..., 1]) & (small >= LIKENESS * large - 1e-9) & (both >= least - 1e-6)


def pairs_of_keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, u, v) of the rows (key, node, root, size, place), sorted by key; and the rows of keys of over RUN_ROWS that
    have several roots."""
    edge = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]]))
    sizes, out, own = np.diff(edge), [np.zeros((0, 3), np.int64)], np.ascontiguousarray(rows[:, 1:])
    for s in range(2, RUN_ROWS + 1):
        starts = edge[:-1][sizes == s]
        i, j = np.triu_indices(s, 1)
        g, k = np.nonzero(alike(own[starts[:, None] + i], own[starts[:, None] + j]))
        out.append(np.column_stack([rows[starts[g], 0], own[starts[g] + i[k], 0], own[starts[g] + j[k], 0]]))
    if not len(rows):
        return out[0], rows
    several = np.minimum.reduceat(own[:, 1], edge[:-1]) != np.maximum.reduceat(own[:, 1], edge[:-1])
    return np.concatenate(out), rows[np.repeat((sizes > RUN_ROWS) & several, sizes)]


def pairs_of_cell(rows: np.ndarray, bits: np.ndarray, first: np.ndarray, within: bool) -> np.ndarray:
    """(node, node) that may be alike by their sizes, places and bitmaps: of the rows marked first and the others, or among
    all if within. rows: node, root, size, place."""
    order = np.argsort(rows[:, 2], kind="stable")
    rows, bits, first = rows[order], bits[order], first[order]
    asked = np.arange(len(rows)) if within else np.flatnonzero(first)
    pool = asked if within else np.flatnonzero(~first)
    own, own_bits, sizes = rows[pool], bits[pool], rows[pool, 2]
    until = np.searchsorted(sizes, rows[asked, 2] / LIKENESS + 1e-6, side="right")
    since = asked + 1 if within else np.searchsorted(sizes, LIKENESS * rows[asked, 2] - 1e-6)
    out = [np.zeros((0, 2), np.int64)]
    for i, a, b in zip(asked, since, until, strict=True):
        near = a + np.flatnonzero(alike(own[a:b], rows[i]))
        apart = np.bitwise_count(own_bits[near] ^ bits[i]).sum(1)
        near = near[apart <= (1 - LIKENESS) / (1 + LIKENESS) * (own[near, 2] + rows[i, 2]) + 1e-6]
        out.append(np.column_stack([np.full(len(near), rows[i, 0]), own[near, 0]]))
    return np.concatenate(out)


def prefix_pairs(texts: DataFrame) -> DataFrame:
    """(key, u, v), u < v: every pair of texts of the likeness whose roots differ is among them, once, with a shingle that
    both have. texts: node, root, size, prefix, bitmap."""
    columns = ["key", "node", "root", "size", "place"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root, size = (batch.column(i).to_numpy() for i in range(3))
            found = batch.column(3).to_pylist()
            for a in range(0, len(found), 256):
                n = np.array([len(x) // 8 for x in found[a : a + 256]])
                keys = np.frombuffer(b"".join(found[a : a + 256]), "<i8")
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                made = [keys, *(np.repeat(x[a : a + 256], n) for x in (node, root, size)), place]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=columns)

    def packed(pairs: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        both = np.zeros((len(pairs) + len(hot), 6), np.int64)
        both[: len(pairs), 1], both[: len(pairs), 2], both[: len(pairs), 3] = pairs[:, 0], pairs[:, 1:].min(1, initial=np.iinfo(np.int64).max), pairs[:, 1:].max(1, initial=-1)
        both[len(pairs) :, 0], both[len(pairs) :, 1:] = 1, hot
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in range(6)], names=["hot", *columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, held, passed = np.zeros((0, 3), np.int64), np.zeros((0, 5), np.int64), None
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            if passed is not None and len(rows):
                on = int(np.searchsorted(rows[:, 0], passed, "right"))
                yield packed(none, rows[:on])
                rows = rows[on:]
            if not len(rows):
                held = rows
                continue
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield packed(*pairs_of_keys(rows[:cut]))
            held, passed = rows[cut:], None
            if len(held) > CELL_ROWS:
                yield packed(none, held)
                held, passed = held[:0], held[0, 0]
        yield packed(*pairs_of_keys(held))

    rows = texts.select("node", "root", "size", "prefix").mapInArrow(explode, ", ".join(f"{c} long" for c in columns))
    runs = rows.repartition("key").sortWithinPartitions("key")
    found = materialize(runs.mapInArrow(work, "hot long, " + ", ".join(f"{c} long" for c in columns)), "prefixes")
    # Rows of shared shingles: every block of a key's rows meets every other, all in tasks of their own.
    shared = found.filter("hot = 1").select(*columns)
    load = shared.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks"), F.min("root").alias("a"), F.max("root").alias("z"))
    load = load.filter("a < z").select("key", "blocks")  # one root: all are connected
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = shared.join(load, "key").withColumn("block", block).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", *columns).join(texts.select("node", "bitmap"), "node")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs of (key, i, j): the cells of a key's blocks, each of two blocks' rows at most."""

        def pairs(x: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            made = pairs_of_cell(x[:, 4:], bits, x[:, 2] == x[:, 0], x[0, 0] == x[0, 1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(made), x[0, 3])), pa.array(made.min(1, initial=np.iinfo(np.int64).max)), pa.array(made.max(1, initial=-1))], names=["key", "u", "v"])

        held, bits = np.zeros((0, 8), np.int64), np.zeros((0, BITMAP // 64), np.uint64)
        for batch in batches:
            held = np.concatenate([held, np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns[:-1]])])
            bits = np.concatenate([bits, np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint64).reshape(-1, BITMAP // 64)])
            edge = np.flatnonzero((held[1:, [0, 1, 3]] != held[:-1, [0, 1, 3]]).any(1)) + 1
            for a, b in zip([0, *edge[:-1]], edge, strict=False):
                yield pairs(held[a:b], bits[a:b])
            held, bits = (held[edge[-1] :], bits[edge[-1] :]) if len(edge) else (held, bits)
        if len(held):
            yield pairs(held, bits)

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("i", "j", "block", *columns, "bitmap")
    frequent = ordered.mapInArrow(cells, "key long, u long, v long")
    pairs = found.filter("hot = 0").select("key", F.col("node").alias("u"), F.col("root").alias("v")).unionByName(frequent)
    return pairs.groupBy("u", "v").agg(F.min("key").alias("key"))


# ---- verification

def sets_of(wanted: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """node, size and set (its shingles) of the wanted nodes, each read from the rows of its least id."""
    held = docs.select(F.col("doc_id").alias("id"), *text_key(text_of()), text_of().alias("text"))
    least = materialize(wanted.join(texts.select("node", "h1", "h2", "least"), "node"), "wanted")  # of a known size: a small one is broadcast
    found = least.join(maybe_asked(held, least), ["h1", "h2"]).filter(F.col("least").eqNullSafe(F.col("id"))).select("node", "text")
    made = map_texts(found, lambda ts: [pa.array([shingle_set(t).tobytes() for t in ts], pa.binary())], {"set": ("binary", pa.binary())}, keep=["node"])
    return materialize(made.select("node", (F.octet_length("set") / 8).cast("long").alias("size"), "set"), "sets")


def maybe_asked(held: DataFrame, asked: DataFrame) -> DataFrame:
    """held without most rows whose h1 is none of the asked ones: by a table of 2^ASKED_BITS bits, 64 in a row, which goes to
    all tasks. Texts that none asks for are then not shuffled."""
    word, bit = F.shiftrightunsigned("h1", 64 - ASKED_BITS + 6), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h1, {64 - ASKED_BITS}) & 63 AS int))")
    table = asked.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))  # 2^(ASKED_BITS - 6) rows at most
    on = held.withColumn("__word", word).join(F.broadcast(table), "__word").filter(F.col("__bits").bitwiseAND(bit) != 0)
    return on.select(*held.columns)


def possible_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (key, u, v) that sizes and bitmaps of their texts let be of the likeness."""
    for c in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bitmap").alias(f"bitmap_{c}")), c)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (3, 4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITMAP // 64) for i in (5, 6))
            may = np.bitwise_count(x ^ y).sum(1) <= (1 - LIKENESS) / (1 + LIKENESS) * (a + b) + 1e-6
            may &= np.minimum(a, b) >= LIKENESS * np.maximum(a, b) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(may)) for i in range(5)], names=batch.schema.names[:5])

    def work_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True)
            may = [apart(x, y) <= (1 - LIKENESS) / (1 + LIKENESS) * (a + b) + 1e-6 for a, b, x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(may, pa.bool_())) for i in range(3)], names=batch.schema.names[:3])

    columns = ["key", "u", "v", "size_u", "size_v"]
    passed = materialize(pairs.select(*columns, "bitmap_u", "bitmap_v").mapInArrow(work, ", ".join(f"{c} long" for c in columns)), "passed")
    long = F.least("size_u", "size_v") > WIDE
    wide = passed.filter(long)
    for c in ("u", "v"):
        wide = wide.join(texts.filter(F.col("size") > WIDE).select(F.col("node").alias(c), F.col("wide").alias(f"wide_{c}")), c)
    wide = wide.select(*columns, "wide_u", "wide_v").mapInArrow(work_wide, "key long, u long, v long")
    return passed.filter(~long).select("key", "u", "v").unionByName(wide)


def verify_pairs(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): of the pairs (key, u, v) those of the likeness, or as many as connect what they connect.

    Pairs that the bitmaps tell apart are never fetched. The texts of a key are dealt into blocks; a task compares the
    pairs between two blocks and reads each of their texts once, pairs after texts, as a sorted run.
    """
    pairs = materialize(possible_pairs(pairs.select("key", "u", "v").distinct(), texts), "pairs")
    ends = pairs.select("key", F.col("u").alias("node")).unionByName(pairs.select("key", F.col("v").alias("node"))).distinct()
    sets = sets_of(ends.select("node").distinct(), texts, docs)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES))
    load = ends.join(texts.select("node", "size"), "node").groupBy("key").agg(blocks.alias("blocks")).filter("blocks > 1")
    dealt = pairs.join(load, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = [F.pmod(F.xxhash64(c), "blocks") for c in ("u", "v")]
    cells = materialize(dealt.select("key", F.least(*at).alias("i"), F.greatest(*at).alias("j"), "u", "v"), "cells")
    asked = [cells.select("key", "i", "j", F.col(c).alias("node")) for c in ("u", "v")]
    asked = materialize(asked[0].unionByName(asked[1]).distinct(), "asked")
    held = asked.join(sets.select("node", "set"), "node")
    rows = held.select("key", "i", "j", F.lit(-1).cast("long").alias("u"), F.col("node").alias("v"), "set")
    rows = rows.unionByName(cells.withColumn("set", F.lit(None).cast("binary")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, root = None, {}, {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for batch in slim_batches(batches, "set", 1 << 26):
            out = []
            for key, i, j, u, v, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != (key, i, j):
                    cell, sets, root = (key, i, j), {}, {}
                if u < 0:
                    sets[v] = np.frombuffer(held, np.uint64)
                    continue
                a, b = find(u), find(v)
                if a != b and likeness(sets[u], sets[v]) >= LIKENESS:
                    root[max(a, b)] = min(a, b)
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    runs = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "u")
    return materialize(runs.mapInArrow(work, "u long, v long"), "verified")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """h1, h2, least (doc_id) and root of each distinct text: texts that links of the likeness connect share a root."""
    texts = distinct_texts(docs, bucket_counts(docs))
    early = verify_pairs(fingerprint_pairs(texts).unionByName(neighbour_pairs(texts)), texts, docs)
    rooted = with_roots(texts.select("node", "size", "prefix", "bitmap"), early)
    links = early.unionByName(verify_pairs(prefix_pairs(rooted), texts, docs))
    return with_roots(texts.select("h1", "h2", "least", "node"), links).select("h1", "h2", "least", "root")


def with_roots(texts: DataFrame, links: DataFrame) -> DataFrame:
    """texts with root, the least node that links connect a node to."""
    stars = connected(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return texts.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs less near-duplicates: of each group of documents connected by likeness, the least doc_id stays.

    Null and empty texts are equal texts. A null doc_id stays only where its group has no other; of repeated rows (same
    doc_id and text) one stays. Columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    groups = near_duplicate_groups(docs)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "h1", "h2"))
    stay = groups.groupBy("root").agg(first.alias("first")).select("first.id", F.col("first.h1").alias("s1"), F.col("first.h2").alias("s2"))
    again = docs.select(F.col("doc_id").alias("id"), *text_key(text_of())).groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = again.select(F.col("id").alias("r"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.lit(True).alias("again"))
    same = F.col("id").eqNullSafe(F.col("r")) & (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2"))
    stay = materialize(stay.join(again, same, "left").select("id", "s1", "s2", "again"), "stay")  # of a known size: a small one is broadcast
    held = as_rows(docs, doc=F.col("doc_id"), h1=text_key(text_of())[0], h2=text_key(text_of())[1])
    kept = held.join(stay, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))).filter(F.col("doc").eqNullSafe(F.col("id")))
    repeated = kept.filter("again").dropDuplicates(["h1", "h2"])
    return kept.filter("again IS NULL").select("row.*").unionByName(repeated.select("row.*"))
