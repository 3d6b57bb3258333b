"""Spelling variants: words that one inserted, deleted or replaced code point tells apart, by two-dimensional range reporting.

Words of one length are points: rank in forward order, rank in the order of their reversals. A word that differs from a
point at one place shares what is before it and what is after it: the first is an interval of the forward order, the
second one of the reverse order, and a wavelet tree reports the points in both. So every report is a near word.

A vocabulary of any size is dealt by halves: words that differ in their second half share the first, and the other way
round. A group of too many words is dealt again, by halves of its half, until one place is left: what shares all the rest
is at most a word for each letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slim_batches, table

RUN = re.compile("[a-zÀ-ÿ]+")
DAMAGED, SHORTEST, OFTEN, TIMES = 31, 7, 2, 10
#: Words of a task are counted on until there are so many; words and code points that one wavelet tree holds, but for a
#: group that has more at a single place.
COUNTED, TREE_WORDS, TREE_CODES = 1 << 17, 1 << 14, 1 << 21


# ---- words

def words_of(doc_id: int | None, text: str, shortest: int = SHORTEST) -> Counter:
    """Runs of letters, A-Z lower-cased, and how often each occurs; of every 31st, by the hash of document and run, a letter
    is gone. A null id is the empty string."""
    runs: Counter = Counter(m.group() for m in RUN.finditer(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    before, out = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), Counter()
    before = zlib.crc32(b":", before)
    for run, n in runs.items():
        if len(run) >= shortest:
            h = zlib.crc32(run.encode(), before)
            if h % DAMAGED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < shortest:
                    continue
            out[run] += n
    return out


def vocabulary(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """(word, n) of the words of all texts that occur so often, as a table. docs: doc_id, text; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slim_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(words_of(doc_id, text or ""))
                if len(held) >= COUNTED:
                    yield packed(held)
                    held = Counter()
        yield packed(held)

    def packed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return materialize(parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often), "vocabulary")


# ---- points in two orders

class WaveletTree:
    """A permutation's values, bit by bit, each level stably split by its bit: answers what lies in a range of both places
    and values. Queries are answered many at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit & 1) == 0
            rank = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((bit, rank))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [c, d) at the places [a, b) of each query."""
        q, left, right, base = np.arange(len(a)), a, b, np.zeros(len(a), np.int64)
        for bit, rank in self.levels:
            l0, r0, zeros = rank[left], rank[right], rank[-1]
            q, base = np.concatenate([q, q]), np.concatenate([base, base | 1 << bit])
            left, right = np.concatenate([l0, zeros + left - l0]), np.concatenate([r0, zeros + right - r0])
            on = (left < right) & (base < d[q]) & (base + (1 << bit) > c[q])
            q, left, right, base = q[on], left[on], right[on], base[on]
        return q, base


class Order:
    """Words in an order, with the length of the prefix that each shares with the one before it."""

    def __init__(self, words: list[str], codes: np.ndarray, point: np.ndarray) -> None:
        self.by = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.by] = np.arange(len(words))
        self.common = np.empty(len(words), np.int64)
        self.common[0] = -1
        for i in range(1, len(words), 4096):
            x, y = codes[self.by[i : i + 4096]], codes[self.by[i - 1 : i - 1 + len(self.by[i : i + 4096])]]
            self.common[i : i + 4096] = (x != y).argmax(1)
        self.points = np.concatenate([[0], np.cumsum(point[self.by])])

    def longest(self) -> np.ndarray:
        """For each word the longest prefix that it shares with another."""
        return np.maximum(self.common, np.append(self.common[1:], -1))[self.rank]

    def interval(self, length: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks among the points, [a, b), of those that share a prefix of a length with each word asked for."""
        edge = np.append(np.flatnonzero(self.common < length), len(self.by))
        at = np.searchsorted(edge, self.rank[of], side="right")
        return self.points[edge[at - 1]], self.points[edge[at]]


def near_pairs(words: list[str], length: int, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (word, point) of distinct words: points have a length, the others are one shorter. The two differ at one of
    the places first to last (exclusive) alone; an insertion into a run of a letter counts at its start. Each pair of two
    points comes both ways, each pair of another word and a point once."""
    point = np.fromiter((len(w) == length for w in words), bool, len(words))
    if not point.any() or len(words) < 2:
        return
    codes = np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length)
    back = [w[::-1] for w in words]
    forward, reverse = Order(words, codes, point), Order(back, np.array(back, f"U{length}").view(np.uint32).reshape(len(words), length), point)
    by_forward = forward.by[point[forward.by]]
    by_reverse = reverse.by[point[reverse.by]]
    tree = WaveletTree(reverse.points[reverse.rank[by_forward]])
    # A place matters to a word only if others share what is before it, and others what is after it.
    since, until = np.maximum(first, length - 1 - reverse.longest()), np.minimum(last - 1, forward.longest())
    some = np.flatnonzero(since <= until)
    if not len(some):
        return
    for place in range(int(since[some].min()), int(until[some].max()) + 1):
        asked = some[(since[some] <= place) & (place <= until[some])]
        if not len(asked):
            continue
        (a, b), (c, d) = forward.interval(place, asked), reverse.interval(length - 1 - place, asked)
        on = (a < b) & (c < d)
        query, value = tree.report(a[on], b[on], c[on], d[on])
        u, v = asked[on][query], by_reverse[value]
        keep = u != v
        if place:
            keep &= point[u] | (codes[v, place] != codes[v, place - 1])
        yield u[keep], v[keep]


class Partials:
    """For each word: how many near ones, and the one of largest n, ties to the smallest."""

    def __init__(self) -> None:
        self.out: list[tuple[list, list, list, list]] = []

    def add(self, words: list[str], counts: list[int], length: int, first: int, last: int) -> None:
        n = np.array(counts, np.int64)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in near_pairs(words, length, first, last):
            other = np.fromiter((len(words[i]) < length for i in a.tolist()), bool, len(a))
            u += [a, b[other]]
            v += [b, a[other]]
        u, v = np.concatenate(u), np.concatenate(v)
        if not len(u):
            return
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place[v], -n[v], u))
        u, v = u[order], v[order]
        edge = np.flatnonzero(np.diff(u, prepend=-1))
        size = np.diff(np.append(edge, len(u)))
        self.out.append(([words[i] for i in u[edge].tolist()], size.tolist(), [words[i] for i in v[edge].tolist()], n[v[edge]].tolist()))

    def taken(self) -> pa.RecordBatch:
        columns = [[x for part in self.out for x in part[i]] for i in range(4)]
        self.out = []
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "k", "best", "best_n"])


# ---- groups

def dealt(rows: DataFrame) -> DataFrame:
    """rows (word, n, size, first, last) with key: words of a size, or one shorter, that share what is before the first and
    after the last place."""
    behind = F.col("size") - F.col("last")  # as many code points at the end
    tail = F.when(behind > 0, F.substring("word", F.char_length("word") - behind + 1, behind)).otherwise("")
    return rows.withColumn("key", F.xxhash64("size", "first", "last", F.substring("word", F.lit(1), F.col("first")), tail))


def halves(rows: DataFrame) -> DataFrame:
    """Every row twice: for the first and the second half of its places."""
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    parts = F.array(F.struct(F.col("first").alias("f"), middle.alias("l")), F.struct(middle.alias("f"), F.col("last").alias("l")))
    each = rows.select("word", "n", "size", F.explode(parts).alias("p"))
    return dealt(each.select("word", "n", "size", F.col("p.f").alias("first"), F.col("p.l").alias("last")))


def partial_counts(rows: DataFrame) -> DataFrame:
    """(word, k, best, best_n) of groups that a tree holds: the near words found in them, summed up in each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, key, codes = ([], []), None, None, 0  # groups at the same places go into one tree
        group: tuple[list, list] = ([], [])
        found = Partials()

        def flush() -> None:
            nonlocal held, codes
            if len(held[0]) > 1:
                found.add(*held, *at)
            held, codes = ([], []), 0

        def close() -> None:
            """The group is complete: one of a single word, or without a point, tells nothing."""
            nonlocal group, codes
            if len(group[0]) > 1:
                more = len(group[0]) * at[0]
                if held[0] and (len(held[0]) + len(group[0]) > TREE_WORDS or codes + more > TREE_CODES):
                    flush()
                held[0].extend(group[0])
                held[1].extend(group[1])
                codes += more
            group = ([], [])

        for batch in batches:
            for word, n, size, first, last, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (size, first, last) != at:
                    if at is not None:
                        close()
                        flush()
                    at, key = (size, first, last), k
                elif k != key:
                    close()
                    key = k
                group[0].append(word)
                group[1].append(n)
            yield found.taken()
        if at is not None:
            close()
            flush()
        yield found.taken()

    runs = rows.repartition("size", "first", "last", "key").sortWithinPartitions("size", "first", "last", "key")
    return runs.select("word", "n", "size", "first", "last", "key").mapInArrow(work, "word string, k long, best string, best_n long")


def near_words(words: DataFrame, most: int = TREE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near ones: how many, and the one of largest n, ties to
    the smallest. Words are distinct and not empty; groups of over so many are dealt by halves of their places."""
    sizes = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1))
    rows = halves(words.select("word", "n", sizes.alias("size")).withColumns({"first": F.lit(0), "last": F.col("size")}))
    parts = []
    while True:
        loads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("load"), F.max(F.col("last") - F.col("first")).alias("places"))
        large = materialize(loads.filter((F.col("load") > most) & (F.col("places") > 1)).select("key"), "large")
        if large.isEmpty():
            parts.append(partial_counts(rows))
            break
        parts.append(partial_counts(rows.join(large, "key", "left_anti")))
        rows = materialize(halves(rows.join(large, "key")), "halves")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("w")))
    return out.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.less")).alias("best_n"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last. A form's n is a multiple of its word's, so there is no
    circle; steps double each round."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, often: int = OFTEN, times: int = TIMES, most: int = TREE_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts (doc_id, text) that occurs so often.

    Null and empty texts have no words; a null doc_id is hashed as the empty string; repeated rows count as often as they
    occur. A word's form is its near word of largest n, ties to the smallest, if that is at least times the word's n. An
    empty table gives an empty one. Other columns don't matter.
    """
    words = vocabulary(docs, often)
    near = near_words(words, most)
    known = words.join(near, "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    formed = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "near")
    roots = followed(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words' number, form and root. Edge cases as in variants."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
