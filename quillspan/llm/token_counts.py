"""Token counts of whole texts with a public tokenizer's own library.

Huge texts are encoded in overlapping chunks with offsets. Two neighbours are spliced at a boundary in their overlap
that is tested to be stable: white space stands before it in the text and both encodings agree, in ids and offsets, on the
tokens on both sides of it. Where no boundary qualifies, the overlap is doubled, up to the whole rest of the text.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

CHUNK, OVERLAP, AGREE, LIMIT = 1 << 16, 1 << 10, 4, 2048
#: Texts for one call of the library: their encodings are what takes memory.
BATCH_BYTES = 1 << 19


class Encoder:
    """One of the libraries behind one face: counts of texts, and (start, end, id) of a piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = path.endswith(".model")
        if self.model:
            import sentencepiece

            self.t = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(path)
            self.t.no_truncation()
            self.t.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        if self.model:
            return [len(x) for x in self.t.encode(texts, num_threads=1)]
        return [len(e) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[tuple[int, int, int]]:
        if self.model:
            proto = self.t.encode(text, return_type="proto")
            # Its offsets are bytes: count the code points that begin before each.
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            return [(int(point[p.begin]), int(point[p.end]), p.id) for p in proto.pieces]
        e = self.t.encode(text, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def stable_boundary(text: str, left: list, right: list, low: int, high: int, agree: int) -> tuple[int, int] | None:
    """Indices into left and right of a common boundary in text[low:high], nearest its middle.

    The boundary follows white space, and the agree tokens before and after it are the same in both.
    """
    starts = [t[0] for t in right]
    best = None
    for i in range(bisect_left(left, (low, 0, 0)), len(left)):
        at = left[i][0]
        if at >= high:
            break
        if not text[at - 1 : at].isspace():
            continue
        j = bisect_left(starts, at)
        if j < agree or i < agree or j + agree > len(right) or i + agree > len(left):
            continue
        if left[i - agree : i + agree] == right[j - agree : j + agree] and (best is None or abs(2 * at - low - high) < best[0]):
            best = abs(2 * at - low - high), i, j
    return best and best[1:]


def count_huge(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> int:
    """The number of tokens of a text of any length, from chunks of about chunk code points."""
    total, start, end = 0, 0, min(chunk, len(text))
    held = enc.pieces(text[:end])  # tokens from the last splice on, with offsets into the text
    while end < len(text):
        wide = overlap
        while True:
            begin = max(start, end - wide)
            stop = len(text) if begin <= start else min(len(text), begin + max(chunk, 2 * wide))
            if begin <= start:  # nothing left to overlap with: the rest of the text at once
                held, end = [(a + start, b + start, i) for a, b, i in enc.pieces(text[start:])], len(text)
                break
            right = [(a + begin, b + begin, i) for a, b, i in enc.pieces(text[begin:stop])]
            if cut := stable_boundary(text, held, right, begin, end, agree):
                total += cut[0]
                held, start, end = right[cut[1] :], right[cut[1]][0], stop
                break
            wide *= 2
    return total + len(held)


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", to: str = "n_tokens", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """docs with the number of tokens of a text column, without special tokens added.

    path names a tokenizer file that every executor has. Null and empty texts have 0 tokens. Texts of over chunk code
    points are encoded in chunks, others whole. Rows are counted one by one: repeated rows agree, nulls elsewhere don't
    matter. A column named as the result gives way; keep names the columns to return, all by default. An empty table
    gives an empty one.
    """

    def count(texts: list[str]) -> list[pa.Array]:
        enc = encoder(path)
        short = enc.counts([t if len(t) <= chunk else "" for t in texts])
        return [pa.array([n if len(t) <= chunk else count_huge(enc, t, chunk, overlap) for t, n in zip(texts, short, strict=True)], pa.int64())]

    return map_texts(docs, count, {to: ("long", pa.int64())}, text, keep, BATCH_BYTES)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bytes, tokens and whether these are over the limit, of every document. A null text is empty and has none."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "n_bytes"])
    return counted.select("*", (F.col("n_tokens") > LIMIT).alias("over_limit"))
