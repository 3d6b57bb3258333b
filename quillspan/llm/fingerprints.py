"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame operations only.

A sketch is the k smallest distinct XXH64 hashes of a text's shingles, ascending. Sketches of parts merge into the
sketch of the whole; two sketches estimate resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, free_name, put, table, text_of

K, SHINGLE = 128, 5
_MAX = 2.0**64


def words(text: Column) -> Column:
    """Words between ASCII white space, lower-cased."""
    return F.array_remove(F.split(F.btrim(F.lower(text), F.lit(SPACES)), r"[\x20\x09-\x0D]+", -1), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, n: int = SHINGLE) -> Column:
    """A hash for each n consecutive words; the whole sequence if there are fewer; none if there are none."""
    last = F.size(hashes) - n
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(last < 0, F.array(F.xxhash64(hashes))).otherwise(each)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, to: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text column. Steps are columns of their own, so that none is computed twice."""
    hashed, every = free_name(df, "__words"), free_name(df, "__all")
    df = df.withColumn(hashed, word_hashes(text_of(text)))
    return put(df.withColumn(every, shingle_hashes(F.col(hashed), n)), **{to: bottom_k(F.col(every), k)}).drop(hashed, every)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, by: list[str], sketch: str, k: int = K, fan_in: int = 64) -> DataFrame:
    """One sketch for each value of by, however many rows have it: hashes are made distinct and cut to k in two rounds,
    the first over fan_in slices of a group."""
    each = df.select(*by, F.explode(sketch).alias("__hash")).distinct()
    for key in ([*by, F.pmod(F.xxhash64("__hash"), F.lit(fan_in)).alias("__slice")], by):
        if len(key) > len(by):
            each = each.select("*", key[-1])
        rank = Window.partitionBy(*by, *(["__slice"] if len(key) > len(by) else [])).orderBy("__hash")
        each = each.withColumn("__r", F.row_number().over(rank)).filter(F.col("__r") <= k)
        each = each.drop("__r", "__slice")
    return each.groupBy(*by).agg(F.sort_array(F.collect_list("__hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard likeness: the share of the union's k smallest hashes that both have. Two empty sketches: 1."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, (k - 1) over the k-th smallest hash as a share of the range beyond."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(_MAX)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, at most 1. An empty a: 1."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def sketch_text(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next_text(docs: DataFrame, slices: int) -> DataFrame:
    """doc_id, text, and the rows that the next one stands on: documents in descending doc_id, dealt to slices.

    Slice bounds are doc_ids of the table, so the last row of a slice is followed by the rows of its bound, which go to
    both slices (__extra marks the second copies). The bounds are a fixed number of quantiles, no data of all rows.
    Null ids come last, in a slice of their own; the next document after the last is the first.
    """
    d = docs.select("doc_id", text_of().alias("text"))
    q = [i / slices for i in range(slices + 1)]
    bounds = d.agg(F.percentile_approx("doc_id", q, max(10_000, 20 * slices)).alias("q"), F.max("doc_id").alias("top"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    edges = sorted({*(bounds["q"] or []), *([bounds["top"]] if bounds["top"] is not None else [])})
    if not edges:
        return d.select("*", F.lit(0).alias("__slice"), F.explode(F.array(F.lit(0), F.lit(1))).alias("__extra"))
    known = F.array(*[F.lit(e) for e in edges])
    # Slice i holds ids above edge i-1 up to edge i; slice -1 the null ids. The first edge is at or above the least id.
    own = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(known, lambda e: e < F.col("doc_id"))))
    at = d.withColumn("__own", own)
    on_edge = F.array_position(known, F.col("doc_id")).cast("int")  # from 1: the slice that ends just above this edge
    last = -1 if bounds["nulls"] else 0
    extra = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("doc_id") == edges[-1], F.lit(last)).when(on_edge > 0, on_edge)
    if bounds["nulls"]:
        # The first null row follows the least id: send the null rows to slice 0 too.
        extra = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(extra)
    copies = F.when(extra.isNull(), F.array(F.struct(F.col("__own").alias("s"), F.lit(0).alias("e")))).otherwise(
        F.array(F.struct(F.col("__own").alias("s"), F.lit(0).alias("e")), F.struct(extra.alias("s"), F.lit(1).alias("e")))
    )
    return at.select("doc_id", "text", F.explode(copies).alias("__c")).select("doc_id", "text", F.col("__c.s").alias("__slice"), F.col("__c.e").alias("__extra"))


def edited_fingerprints(docs: DataFrame, k: int = K, n: int = SHINGLE, slices: int | None = None) -> DataFrame:
    """Each document's sketch, that of its edited text, and its likeness to that and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document, in
    descending doc_id (nulls last, equal ids by text). A null text is empty; empty texts have the empty sketch, written
    as the empty string, and are alike (1.0). Repeated rows follow one another. A single document is its own next one.
    Other columns are not looked at. An empty table gives an empty one.
    """
    slices = slices or max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = with_next_text(docs, slices).repartition("__slice")
    own = with_sketch(dealt, "text", "__sketch", k, n)
    order = Window.partitionBy("__slice").orderBy("__extra", F.desc_nulls_last("doc_id"), "text")
    seen = own.withColumn("__next", F.lead("text").over(order)).withColumn("__next_sketch", F.lead("__sketch").over(order)).filter("__extra = 0")
    size = seen.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("__half", F.floor(F.col("n_chars") / 2).cast("int"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("__half")).cast("int"))
    edited = size.withColumn("edited_text", F.concat(kept, F.substring(F.col("__next"), F.lit(1), F.col("__half"))))
    both = with_sketch(edited, "edited_text", "__edited", k, n)
    return both.select(
        "doc_id", "text", "edited_text", "n_chars", F.col("__sketch").alias("sketch"), F.col("__edited").alias("edited_sketch"),
        resemblance(F.col("__sketch"), F.col("__edited"), k).alias("near_edited"), resemblance(F.col("__sketch"), F.col("__next_sketch"), k).alias("near_next"),
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text, and their likeness. Edge cases as in edited_fingerprints."""
    out = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
