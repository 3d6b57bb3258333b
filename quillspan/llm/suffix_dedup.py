"""Exact substring dedup: merged Burrows-Wheeler transforms find repeated strings of 100 bytes and more.

1. Every 100-byte window has an anchor, its 32-gram of least hash; the windows in a row that share an anchor form a
   segment. Equal windows have equal anchors, so a segment meets all its rivals under its anchor's hash.
2. Segments that are equal as a whole are found by sorted runs of hashes: all but the first are repeats throughout.
3. Of the distinct segments under an anchor, the bytes are fetched. Blocks of them are cut into shards; each shard's
   transform is made by itself, and the shards are merged by iterative interleave refinement (Holt and McMillan, 2014):
   from order by i symbols to order by i + 1 by one stable distribution of the merged transform, no suffix being sorted
   again. Boundaries between suffixes appear in the round that is their common prefix; after the rounds for 100 bytes,
   what is left undivided are the repeated intervals. Symbols are short byte strings, ranked within the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, materialize, slim_batches, table, text_of

LENGTH, GRAM = 100, 32
_SPAN = LENGTH - GRAM + 1  # anchors to choose from in a window
_POS_BITS = 24
KIND_ROWS = 8192  # kinds of segments of one anchor that are merged in one task
PIECE = 1 << 20  # bytes that are looked at together in step 1, the least
BLOCK, SHARD = 1 << 17, 1 << 14  # bytes merged together, the least; bytes of a shard
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NULL = (1 << 63) - 1  # a null doc_id in order: last

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, r in enumerate((_R, _R_INV)):
            full = np.full(n + n // 4, r, np.uint64)
            full[0] = 1
            _powers[i] = np.cumprod(full, dtype=np.uint64)
    return _powers[0], _powers[1]


def segments_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash, segment hash) of all segments of texts, together below 2^24 bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    n = len(b)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    pow_, inv = _powers_to(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * pow_[:n], dtype=np.uint64)])

    def mix(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    gram = mix((sums[GRAM:] - sums[:-GRAM]) * inv[: n - GRAM + 1])
    mask = np.uint64((1 << _POS_BITS) - 1)
    least = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)  # of equal hashes the first
    width = 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _SPAN:
        least = np.minimum(least[: -(_SPAN - width)], least[_SPAN - width :])
    ends = np.cumsum(lengths)
    windows = np.maximum(lengths - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(ends - lengths, windows)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchor = (least[at] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    a, z = at[new], at[last]
    whole = mix((sums[z + LENGTH] - sums[a]) * inv[a] + (anchor[new] - a).astype(np.uint64) * np.uint64(_R) + (z - a).astype(np.uint64))
    start = (ends - lengths)[text[new]]
    return text[new], a - start, z - start, gram[anchor[new]].view(np.int64), whole.view(np.int64)


_SEGMENT = "again long, h long, sh long, ord long, th long, a long, z long"


def _flagged(x: np.ndarray) -> pa.RecordBatch:
    """Rows h, sh, ord, th, a, z of a batch as an Arrow batch, again being 1 for repeats of an earlier row of it."""
    x = x[np.lexsort((x[:, 4], x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
    new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])[: len(x)]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = ~new & (x[:, 2:5] != x[lead, 2:5]).any(1)
    return pa.RecordBatch.from_arrays([pa.array(again.astype(np.int64)), *(pa.array(x[:, k]) for k in range(6))], names=["again", "h", "sh", "ord", "th", "a", "z"])


def segments(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Segments (anchor hash, own hash, ord, th, first and last window) of rows ord, th, text.

    again marks those that repeat an earlier one of the same batch: they are known as repeats before any shuffle, so a
    passage that very many places share has one row left for each batch that must meet the others'.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches, "text", piece):
            ids = [batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            owner, base, parts = [], [], []
            for i, t in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for k in range(0, max(1, len(t) - LENGTH + 1), piece):  # each window is in one part
                    owner.append(i)
                    base.append(k)
                    parts.append(t[k : k + piece + LENGTH - 1])
            done = 0
            while done < len(parts):
                stop, size = done, 0
                while stop < len(parts) and (stop == done or size + len(parts[stop]) <= 2 * piece):
                    size += len(parts[stop])
                    stop += 1
                i, a, z, h, sh = segments_of(parts[done:stop])
                own, off = np.array(owner[done:stop], np.int64)[i], np.array(base[done:stop], np.int64)[i]
                yield _flagged(np.column_stack([h, sh, ids[0][own], ids[1][own], a + off, z + off]))
                done = stop

    return rows.mapInArrow(work, _SEGMENT)


def judged_segments(found: DataFrame) -> DataFrame:
    """(repeat, h, ord, th, a, z): segments that repeat an earlier one as a whole, and (repeat false) the first ones of
    each kind where an anchor has several kinds. Sorted runs of a hash stream by; no run is held."""
    cols = ["h", "sh", "ord", "th", "a", "z"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the first segment of the run of (h, sh) that goes on
        told = False  # its request has gone out, or an earlier kind of its anchor was seen
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy() for c in batch.columns])
            known, x = x[x[:, 0] == 1, 1:], x[x[:, 0] == 0, 1:]
            if len(known):
                yield packed(np.ones(len(known), bool), known)
            if not len(x):
                continue
            fresh = head is None
            if not fresh:
                x = np.concatenate([head[None], x])
            kind = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])
            first = np.flatnonzero(kind)
            lead = first[np.cumsum(kind) - 1]
            repeat = ~kind & (x[:, 2:5] != x[lead][:, 2:5]).any(1)
            h = x[first, 0]
            same = h[1:] == h[:-1]
            prev, nxt = np.concatenate([[told and not fresh], same]), np.concatenate([same, [False]])
            # The head of a carried run was sent before if it had been told.
            ask = (prev | nxt) & ~np.concatenate([[told and not fresh], np.zeros(len(first) - 1, bool)])
            out = np.concatenate([np.flatnonzero(repeat), first[ask]])
            is_repeat = np.concatenate([np.ones(int(repeat.sum()), bool), np.zeros(int(ask.sum()), bool)])
            head = x[first[-1]]
            told = bool(prev[-1])
            yield packed(is_repeat, x[out])

    def packed(repeat: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(repeat), *(pa.array(y[:, i]) for i in (0, 2, 3, 4, 5))], names=["repeat", "h", "ord", "th", "a", "z"])

    deal = F.when(F.col("again") == 1, F.xxhash64("ord", "th", "a")).otherwise(F.col("h"))
    runs = found.repartition(deal).sortWithinPartitions("again", *cols)
    return runs.mapInArrow(work, "repeat boolean, h long, ord long, th long, a long, z long")


# ---- transforms of a block and their merge

def _symbols(b: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """A rank from 1 for the g bytes from each place on, shorter at the end of its segment; and g, the most of 10, 5, 4,
    2 and 1 that leaves fewer than 2^16 ranks, so that a distribution by them is two passes over bytes."""
    n = len(b)
    place = np.arange(n)
    padded = np.concatenate([b.astype(np.uint32) + 1, np.zeros(5, np.uint32)])

    def ranks(g: int) -> tuple[np.ndarray, int]:
        value = np.zeros(n, np.uint64)
        for i in range(g):
            value = value * np.uint64(257) + np.where(place + i < end, padded[i : n + i], 0)
        names, rank = np.unique(value, return_inverse=True)
        return rank + 1, len(names)

    five, n_five = ranks(5)
    if n_five < (1 << 16) - 1:
        later = np.where(place + 5 < end, np.concatenate([five[5:], np.zeros(min(5, n), five.dtype)])[:n], 0)
        names, rank = np.unique(five * (n_five + 1) + later, return_inverse=True)
        return ((rank + 1).astype(np.uint16), 10) if len(names) < (1 << 16) - 1 else (five.astype(np.uint16), 5)
    for g in (4, 2, 1):
        rank, k = ranks(g)
        if k < (1 << 16) - 1 or g == 1:
            return rank.astype(np.uint16), g
    raise AssertionError


def _suffixes(sym: np.ndarray, nxt: np.ndarray, longest: int) -> np.ndarray:
    """The places of a shard in the order of their suffixes, by doubling up to the longest string; equal ones by place."""
    rank = np.concatenate([sym.astype(np.int64), [0]])  # place n: past the end
    step = np.concatenate([nxt, [len(nxt)]])
    have = 1
    while have < longest:
        pair = rank * (len(rank) + (1 << 16)) + rank[step]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step, have = step[step], 2 * have
    return np.argsort(rank[:-1], kind="stable")


def merged_order(b: np.ndarray, start: np.ndarray, shard: int = SHARD, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of a block of segments (bytes b, starts) in merged order; for each the symbols that it has in common with the
    place before it, up to those of length bytes; and the bytes of a symbol.

    Places with fewer bytes left in their segment are in the order too, what they have in common means nothing.
    """
    n = len(b)
    end = np.concatenate([start[1:], [n]])
    seg = np.zeros(n, np.int64)
    seg[start[1:]] = 1
    seg = np.cumsum(seg)
    sym, g = _symbols(b, end[seg])
    rounds = length // g
    place = np.arange(n)
    # Each segment is g strings of symbols, by the remainder of the place; a string ends where g bytes on is outside.
    # Shards are runs of whole segments.
    size = np.cumsum(end - start)
    shard_of = np.minimum((size - 1) // shard, 254)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard_of)) + 1, [len(start)]])
    arrays, transforms, ids = [], [], []
    for k in range(len(cuts) - 1):
        lo, hi = start[cuts[k]], end[cuts[k + 1] - 1]
        nxt = np.where(place[lo:hi] + g < end[seg[lo:hi]], place[lo:hi] + g - lo, hi - lo)
        sa = _suffixes(sym[lo:hi], nxt, -(-int((end - start).max()) // g)) + lo
        arrays.append(sa)
        # The transform: the symbol before each suffix, 0 for none; the ends of the strings come first, in order.
        before = np.where(sa - g >= start[seg[sa]], sym[np.maximum(sa - g, 0)], 0)
        tails = place[lo:hi][nxt == hi - lo]
        transforms.append((tails, before))
        ids.append(k)
    # Rows of the merged matrix: first the empty suffixes, one for each string, then all others.
    heads = [sym[t] for t, _ in transforms]
    bwt = [np.concatenate([h, w]).astype(np.uint16) for h, (_, w) in zip(heads, transforms, strict=True)]
    every = np.concatenate(bwt)
    empties = sum(map(len, heads))
    z = np.concatenate([np.repeat(np.array(ids, np.uint8), [len(h) for h in heads]), np.repeat(np.array(ids, np.uint8), [len(w) for _, w in transforms])])
    block = np.zeros(len(z), np.int64)  # by no symbols, all are alike
    live = int((every > 0).sum())
    assert live == n
    common = np.full(live, rounds)  # a boundary between suffixes stays where it is; it appears in the round of their common prefix
    for i in range(rounds):
        s = np.empty(len(z), np.uint16)
        s[np.argsort(z, kind="stable")] = every
        order = np.argsort(s, kind="stable")[len(z) - live :]  # symbol 0 leads to no suffix
        s, before = s[order], block[order]
        parted = np.concatenate([[True], (s[1:] != s[:-1]) | (before[1:] != before[:-1])])
        common[parted & (common == rounds)] = i
        z[empties:] = z[order]
        block[empties:] = np.cumsum(parted)
    merged = np.empty(live, np.int64)
    merged[np.argsort(z[empties:], kind="stable")] = np.concatenate(arrays)
    return merged, common, g


def repeated_classes(b: np.ndarray, start: np.ndarray, shard: int = SHARD, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in merged order, and their repeated intervals: runs whose common prefixes are length bytes and more."""
    merged, common, g = merged_order(b, start, shard, length)
    return merged, np.cumsum(common < length // g)


def repeated_windows(pieces: list[bytes], where: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Of segments at where (ord, th, first window): rows ord, th, window of the windows that start earlier elsewhere."""
    lengths = np.array([len(p) for p in pieces])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order, cls = repeated_classes(np.frombuffer(b"".join(pieces), np.uint8), start, shard)
    seg = np.searchsorted(start, order, side="right") - 1
    full = order - start[seg] + LENGTH <= lengths[seg]
    order, cls, seg = order[full], cls[full], seg[full]
    again = np.concatenate([[False], cls[1:] == cls[:-1]])
    shared = again | np.concatenate([again[1:], [False]])
    order, cls, seg = order[shared], cls[shared], seg[shared]
    at = np.column_stack([where[seg, 0], where[seg, 1], where[seg, 2] + order - start[seg]])
    ranked = np.lexsort((at[:, 2], at[:, 1], at[:, 0], cls))
    at, cls = at[ranked], cls[ranked]
    first = np.concatenate([[True], cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, bool)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(cls) else np.zeros(0, np.int64)
    return at[(at != at[lead]).any(1)]


def ranges_of(at: np.ndarray) -> np.ndarray:
    """Rows ord, th, window as runs: ord, th, first and last window."""
    if not len(at):
        return np.zeros((0, 4), np.int64)
    at = at[np.lexsort((at[:, 2], at[:, 1], at[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (at[1:, :2] != at[:-1, :2]).any(1) | (np.diff(at[:, 2]) > 1)]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return np.column_stack([at[new], at[last, 2]])


def merged_repeats(cut: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ord, th, a, z) windows of segments h, ord, th, a, piece (bytes) that start earlier in a segment of the same h."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush(held: list[tuple]) -> pa.RecordBatch:
            r = ranges_of(repeated_windows([x[4] for x in held], np.array([x[1:4] for x in held], np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(r[:, i]) for i in range(4)], names=["ord", "th", "a", "z"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= block and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield flush(rows)

    return cut.repartition("h").sortWithinPartitions("h").mapInArrow(work, "ord long, th long, a long, z long")


def with_text(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(ord, th, text, asked) of the rows that segments h, ord, th, a, z are in."""
    return rows.join(asked.groupBy("ord", "th").agg(F.collect_list(F.struct("h", "a", "z")).alias("asked")), ["ord", "th"]).select("ord", "th", "text", "asked")


def pieces_of(fetched: DataFrame) -> DataFrame:
    """(h, ord, th, a, piece): the bytes of segments."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for ord_, th, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for s in asked:
                    for x, y in zip(out, (s["h"], ord_, th, s["a"], data[s["a"] : s["z"] + LENGTH]), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], names=["h", "ord", "th", "a", "piece"])

    return fetched.mapInArrow(cut, "h long, ord long, th long, a long, piece binary")


def windows_of(fetched: DataFrame) -> DataFrame:
    """Each window of segments as a segment of its own: h, a hash of its bytes, ord, th, its place twice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches, "text"):
            out = []
            for ord_, th, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                pow_, inv = _powers_to(len(b) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * pow_[: len(b)], dtype=np.uint64)])
                for s in asked:
                    at = np.arange(s["a"], s["z"] + 1)
                    own = ((sums[at + LENGTH] - sums[at]) * inv[at]).view(np.int64)
                    out.append(np.column_stack([np.full(len(at), s["h"]), own, np.full(len(at), ord_), np.full(len(at), th), at, at]))
            if out:
                yield _flagged(np.concatenate(out))

    return fetched.mapInArrow(cut, _SEGMENT)


def removed_bytes(docs: DataFrame, most: int = KIND_ROWS) -> DataFrame:
    """(ord, th, ranges) for rows that lose bytes: runs of windows that start earlier elsewhere, unordered.

    Kinds of segments of one anchor are merged in one task; of anchors with over most kinds, each window is a segment of
    its own instead, judged in sorted runs as the whole segments are, so no anchor is too much for a task.

    ord is the doc_id (null: last), th the XXH64 of the text; together they name a row, and rows alike in both are one.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("ord"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    judged = materialize(judged_segments(segments(rows)), "segments")
    asked = judged.filter(~F.col("repeat")).select("h", "ord", "th", "a", "z")
    often = materialize(asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("h"), "often")
    every = judged.filter("repeat").select("ord", "th", "a", "z")
    if not often.isEmpty():
        hot = windows_of(with_text(asked.join(often, "h", "left_semi"), rows))
        every = every.unionByName(judged_segments(hot).filter("repeat").select("ord", "th", "a", "z"))
        asked = asked.join(often, "h", "left_anti")
    fine = merged_repeats(pieces_of(with_text(asked, rows)))
    every = every.unionByName(fine)
    return every.groupBy("ord", "th").agg(F.collect_list(F.struct("a", "z")).alias("ranges"))


def dedup_substrings(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs with kept (binary: the bytes of the text that stay), n_bytes, n_removed and n_spans (runs removed).

    A byte goes if a 100-byte string covers it that also starts earlier: in a smaller doc_id or at a smaller place of the
    same document; strings are those of the input. A null text is empty; a null doc_id comes last. Rows alike in doc_id
    and text are one document and lose the same; rows of a doc_id with different texts are in the order of the texts'
    hashes. Columns named as the results give way; keep names the columns to return, all by default. An empty table gives
    an empty one.
    """
    results = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    row_id = {"own": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), "hash": F.xxhash64(text_of())}
    joined = as_rows(docs, **row_id).join(removed_bytes(docs), (F.col("own") == F.col("ord")) & (F.col("hash") == F.col("th")), "left")
    field = F.col("row").getField
    ready = joined.select(*[field(c).alias(c) for c in names], text_of(field("text")).alias("text of the row"), F.col("ranges").alias("ranges of the row"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches, "text of the row"):
            out: tuple[list, ...] = ([], [], [], [])
            for text, ranges in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, done, spans = [], 0, 0
                reach = -1
                for a, z in sorted((r["a"], r["z"]) for r in ranges or ()):
                    if a > reach:
                        spans += 1
                        kept.append(data[done:a])
                    reach = max(reach, z + LENGTH)
                    done = reach
                kept.append(data[done:])
                body = b"".join(kept)
                for x, y in zip(out, (body, len(data), len(data) - len(body), spans), strict=True):
                    x.append(y)
            arrays = [pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *arrays], names=[*names, *results])

    schema = ["`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in ready.schema.fields[: len(names)]]
    return ready.mapInArrow(apply, ", ".join([*schema, "kept binary", "n_bytes long", "n_removed long", "n_spans long"]))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: bytes, those removed, in how many runs, and the hash of the rest. Edge cases as in dedup_substrings."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
