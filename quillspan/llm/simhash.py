"""SimHash near-dedup by the generalised pigeonhole principle (Qin et al., 2018).

Correlated bits of the 64 share a partition. Partitions get unequal thresholds that add up to tau - m + 1 (-1: not
probed) by dynamic programming on estimated candidate counts: two fingerprints within tau bits are within its threshold
in one partition at least. Fingerprints are probed by partition and verified on all bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, table
from .components import connected

BITS, TAU, SHINGLE, SEED = 64, 2, 3, 42
#: Work of shuffling one row for a probe, some microseconds, in comparisons of two fingerprints, some nanoseconds each.
PROBE_COST = 200.0
#: Rows of one key of a partition that are compared in one task; larger keys are dealt by further bits first.
KEY_ROWS = 1 << 14
_PIECE = 1 << 15


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest first."""
    out = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _PIECE):
        out += np.unpackbits(hashes[i : i + _PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return out


def majority(sums: np.ndarray, k: int) -> int:
    """The bits set in over half of k hashes, as a signed number."""
    return int.from_bytes(np.packbits(2 * sums > k).tobytes(), "big", signed=True)


def fingerprint(text: str, n: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - n + 1)
    a, b = starts[:k].tolist(), ends[min(n, len(words)) - 1 :].tolist()
    count, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, k, _PIECE):
        count += bit_sums(np.array([h(flat[x:y], seed) for x, y in zip(a[i : i + _PIECE], b[i : i + _PIECE], strict=True)], np.uint64))
    return majority(count, k)


def with_fingerprints(docs: DataFrame, n: int = SHINGLE, text: str = "text", to: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """docs with the fingerprint of a text column; a null or empty text has fingerprint 0."""
    return map_texts(docs, lambda texts: [pa.array([fingerprint(t, n) for t in texts], pa.int64())], {to: ("long", pa.int64())}, text, keep)


# ---- the partitioning

class Layout(NamedTuple):
    masks: list[int]  # unsigned, one for each partition
    thresholds: list[int]


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, for all i and j: 4096 numbers, whatever the table's size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy().astype("<u8").view(np.uint8).reshape(-1, 8)
            for i in range(0, len(x), 1 << 14):
                bits = np.unpackbits(x[i : i + (1 << 14)], axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in sums:
        out[r["cell"]] = r["n"]
    return out.reshape(BITS, BITS)


def grouped_bits(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each starts with a free bit and takes the free bits most correlated to it."""
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        seed = max(sorted(free), key=lambda i: max((corr[i, j] for j in free if j != i), default=0.0))
        part = [seed]
        free.discard(seed)
        while len(part) < width:
            best = max(sorted(free), key=lambda j: sum(corr[i, j] for i in part))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """The cheapest thresholds: costs[i][e + 1] is partition i's cost at threshold e, -1 and up; they add up to tau - m + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (total, (cost, chosen)), e in product(best.items(), range(-1, len(row) - 1)):
            if (s := total + e) not in step or cost + row[e + 1] < step[s][0]:
                step[s] = (cost + row[e + 1], [*chosen, e])
        best = step
    return best[tau - len(costs) + 1]


def choose_layout(fps: DataFrame, n: int, tau: int) -> Layout:
    """The cheapest partitioning and thresholds. Pairs that agree in a partition are counted over all fingerprints;
    those that differ in e bits there are estimated from the bits' frequencies."""
    counts = bit_counts(fps)
    p = np.diag(counts) / max(n, 1)
    q = 2 * p * (1 - p)
    odds = q / (1 - q)
    options = {m: grouped_bits(counts, n, m) for m in range(max(2, tau // 2), tau + 3)}
    masks = {(m, i): sum(1 << b for b in part) for m, parts in options.items() for i, part in enumerate(parts)}
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("v")) for k, mask in enumerate(masks.values())])
    same = fps.select(F.explode(keys).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = {r["k"]: r["pairs"] for r in same.groupBy("k").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).collect()}
    at = {key: k for k, key in enumerate(masks)}
    found = []
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            # Elementary symmetric sums of the odds: pairs at distance exactly e over pairs at distance 0.
            e_sums = np.zeros(tau + 1)
            e_sums[0] = 1
            for b in part:
                e_sums[1:] += odds[b] * e_sums[:-1].copy()
            row, probes = [0.0], 0.0
            for e in range(tau + 1):
                probes += float(_choose(len(part), e))
                row.append(PROBE_COST * max(n, 1) * probes + pairs.get(at[m, i], 0.0) * float(e_sums[: e + 1].sum()))
            costs.append(row)
        cost, thresholds = allocate(costs, tau)
        found.append((cost, m, Layout([masks[m, i] for i in range(m)], thresholds)))
    return min(found, key=lambda x: x[:2])[2]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ---- probing and verifying

def probe_rows(nodes: DataFrame, layout: Layout) -> DataFrame:
    """part, key and the columns of nodes: each fingerprint under its own bits of each probed partition, and under those
    within its threshold of them."""
    out = None
    for i, (mask, threshold) in enumerate(zip(layout.masks, layout.thresholds, strict=True)):
        if threshold < 0:
            continue
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [sum(1 << b for b in c) for e in range(threshold + 1) for c in combinations(bits, e)]
        key = F.col("fp").bitwiseXOR(F.col("__flip")).bitwiseAND(F.lit(signed(mask)))
        rows = nodes.withColumn("__flip", F.explode(F.array(*[F.lit(signed(f)).cast("long") for f in flips])))
        rows = rows.select(F.lit(i).alias("part"), key.alias("key"), *nodes.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def deal_hot_keys(rows: DataFrame, layout: Layout, tau: int, most: int = KEY_ROWS) -> DataFrame:
    """rows with sub and subkey: keys of over most rows are dealt by the other bits, in tau + 1 chunks. Two rows of a key
    within tau bits agree in one chunk at least, so none is lost."""
    hot = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("part", "key", F.lit(True).alias("hot"))
    choices = []
    for mask in layout.masks:
        rest = [b for b in range(BITS) if not mask >> b & 1]
        chunks = [signed(sum(1 << b for b in rest[k :: tau + 1])) for k in range(tau + 1)]
        choices.append(F.array(*[F.struct(F.lit(k + 1).alias("sub"), F.col("fp").bitwiseAND(F.lit(c)).alias("subkey")) for k, c in enumerate(chunks)]))
    dealt = F.element_at(F.array(*choices), F.col("part") + 1)
    plain = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subkey")))
    joined = rows.join(hot, ["part", "key"], "left")
    own = [c for c in rows.columns if c not in ("part", "key")]
    return joined.select("part", "key", *own, F.explode(F.when(F.col("hot"), dealt).otherwise(plain)).alias("s")).select("part", "key", "s.sub", "s.subkey", *own)


#: Of rows (fp, more columns) and one or several others: which are linked? Arrays of the last axis' columns.
Linked = Callable[[np.ndarray, np.ndarray], np.ndarray]


def within(tau: int) -> Linked:
    # numpy counts the bits of a negative number's magnitude, so numbers are taken as unsigned.
    return lambda a, b: np.bitwise_count((a[..., 0] ^ b[..., 0]).view(np.uint64)) <= tau


def forest(rows: np.ndarray, linked: Linked) -> list[tuple[int, int]]:
    """Places of links that connect what all links among the rows connect: fewer than rows, none twice."""
    left, pool, out = np.arange(len(rows)), rows, []
    while len(left) > 1:
        queue, left, pool = [int(left[0])], left[1:], pool[1:]
        while queue and len(left):
            u = queue.pop()
            near = linked(pool, rows[u])
            if near.any():
                new = left[near].tolist()
                out += [(u, v) for v in new]
                queue += new
                left, pool = left[~near], pool[~near]
    return out


def links_of(keys: np.ndarray, rows: np.ndarray, linked: Linked) -> list[tuple[int, int]]:
    """Places of links within runs of equal keys; small runs of a size are compared all at once."""
    edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
    sizes, out = np.diff(edge), []
    for s in np.unique(sizes):
        starts = edge[:-1][sizes == s]
        if s == 1:
            continue
        if s > 32:
            for a in starts.tolist():
                out += [(a + u, a + v) for u, v in forest(rows[a : a + s], linked)]
            continue
        i, j = np.triu_indices(s, 1)
        for part in np.array_split(starts, max(1, len(starts) * len(i) >> 18)):
            near = linked(rows[part[:, None] + i], rows[part[:, None] + j])
            g, k = np.nonzero(near)
            out += zip((part[g] + i[k]).tolist(), (part[g] + j[k]).tolist(), strict=True)
    return out


def verified_links(dealt: DataFrame, linked: Linked, node: str = "fp") -> DataFrame:
    """(u, v): links of verified pairs, enough to connect each key's rows. Reads keys as sorted runs.

    dealt: part, key, sub, subkey, then fp and what linked looks at, all whole numbers; node names the column to return.
    """
    cols = ["part", "key", "sub", "subkey"]
    own = [c for c in dealt.columns if c not in cols]
    own = ["fp", *(c for c in own if c != "fp")]
    at = 4 + own.index(node)

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        links = np.array(links_of(rows[:, :4], np.ascontiguousarray(rows[:, 4:]), linked), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rows[links[:, 0], at]), pa.array(rows[links[:, 1], at])], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            rows = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if not len(rows):
                continue
            if held and (held[-1][-1, :4] != rows[-1, :4]).any():
                rows, held = np.concatenate([*held, rows]), []
            other = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield packed(rows[:cut])
            held.append(rows[cut:])
        if held:
            yield packed(np.concatenate(held))

    runs = dealt.select(*cols, *own).repartition(*cols).sortWithinPartitions(*cols)
    return runs.mapInArrow(work, "u long, v long")


def link_fingerprints(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """(u, v) links of distinct fingerprints (column fp), whose components are those of all pairs within tau bits."""
    n = fps.count()
    layout = choose_layout(fps, n, tau)
    return verified_links(deal_hot_keys(probe_rows(fps, layout), layout, tau), within(tau))


def similar_groups(marked: DataFrame, tau: int = TAU) -> DataFrame:
    """marked (doc_id, fp, more) with component_id: the smallest doc_id that is reachable over fingerprints within tau
    bits. Copies share a fingerprint and enter as one; null ids never name a component unless it has no other (null)."""
    ids = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    stars = connected(link_fingerprints(ids.select("fp"), tau))
    rooted = ids.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document. Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows stay and share a component; an empty table gives an empty one."""
    marked = materialize(with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]), "marked")
    out = similar_groups(marked)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
