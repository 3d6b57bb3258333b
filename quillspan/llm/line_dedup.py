"""Line dedup, with DataFrame operations only.

Lines become 128-bit hashes that are range-partitioned, sorted by hash, document (largest first) and position, and
streamed by windows over that order: each hash's owner is its first document. Dropped lines come back as compressed
per-document keep bitmaps; text is never shuffled with the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, as_rows, ascii_lower, materialize, table, text_of

MIN_CHARS, MIN_DOCS = 20, 3
#: Frequent hashes that are looked for, and how many are tracked to find them: a bound on what is broadcast.
FREQUENT, TRACKED = 10_000, 100_000
#: Lines of a hash that are streamed in one run; those of a frequent one are dealt to more runs by document.
RUN_ROWS = 1 << 12


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, th, pos, h1, h2) for every line whose key is long enough; th is the XXH64 of its text."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text_of()).alias("th"), F.posexplode(split_lines(text_of())).alias("pos", "line"))
    keys = lines.select("doc", "th", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).filter(F.char_length("key") >= min_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    return keys.select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def frequent_hashes(lines: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(h1, runs): into how many runs the lines of a frequent hash are dealt.

    A sketch over all lines finds them. It decides the dealing alone: results are the same whatever it returns.
    """
    top = lines.select(F.explode(F.expr(f"approx_top_k(h1, {FREQUENT}, {TRACKED})")).alias("t"))
    return top.select(F.col("t.item").alias("h1"), F.ceil(F.col("t.count") / run_rows).cast("int").alias("runs")).filter("h1 is not null and runs > 1")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc, th, dropped map<int, long>) for documents that lose lines.

    The bitmap is word-sparse: entry w holds lines 64w to 64w+63, a set bit drops its line, a missing word keeps all of
    its lines. th is the XXH64 of the text: with doc it names a row, so repeated rows share one bitmap. A null doc_id is
    one document, the smallest.
    """
    lines = materialize(line_hashes(docs, min_chars), "lines")  # hashed once; the sketch, the ranges' sample and the runs read it
    frequent = materialize(frequent_hashes(lines, run_rows), "frequent")
    run = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("runs")).cast("int"), F.lit(0))
    dealt = lines.join(F.broadcast(frequent), "h1", "left").withColumn("run", run)  # at most FREQUENT rows
    first = streamed(dealt)
    # A hash in one run is decided there. The first occurrences of several runs, and the runs' counts, are put together.
    parts = streamed(dealt.filter("runs is not null")).filter("nth = 1").groupBy("h1", "h2").agg(F.max("owner").alias("top"), F.sum("docs").alias("all"))
    parts = materialize(parts.filter(F.col("all") >= min_docs), "runs")
    alone = first.filter(F.col("runs").isNull() & (F.col("docs") >= min_docs)).select("doc", "th", "pos", "owner")
    shared = lines.join(F.broadcast(parts), ["h1", "h2"]).select("doc", "th", "pos", F.col("top").alias("owner"))  # at most FREQUENT rows and hashes that collide with them in 64 bits
    dropped = alone.unionByName(shared).filter(~F.col("doc").eqNullSafe(F.col("owner")))
    words = dropped.groupBy("doc", "th", F.floor(F.col("pos") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return words.groupBy("doc", "th").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("dropped"))


def streamed(dealt: DataFrame) -> DataFrame:
    """Lines with their hash's owner and documents in their run, and their number in it: one range exchange, one sort."""
    keys = ["h1", "h2", "run"]
    order = F.desc_nulls_last("doc")
    ranges = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys, order, "th", "pos")
    stream = Window.partitionBy(*keys).orderBy(order)
    ranked = ranges.withColumn("rank", F.dense_rank().over(stream)).withColumn("nth", F.row_number().over(stream)).withColumn("owner", F.first("doc").over(stream))
    return ranked.withColumn("docs", F.max("rank").over(Window.partitionBy(*keys)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with their remaining text, n_lines (before) and n_dropped."""
    held = as_rows(docs, own=F.col("doc_id"), hash=F.xxhash64(text_of()))
    joined = held.join(bitmaps, F.col("own").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("th")), "left")
    out = joined.select("row", "dropped", split_lines(text_of(F.col("row").getField("text"))).alias("lines"))
    # A dense array of words, so that each line is one lookup.
    dense = "transform(sequence(0, cast((size(lines) - 1) div 64 as int)), w -> coalesce(element_at(dropped, w), 0L))"
    kept = "filter(lines, (line, i) -> (shiftright(element_at(dense, cast(i div 64 as int) + 1), i % 64) & 1) = 0)"
    out = out.withColumn("dense", F.when(F.col("dropped").isNotNull(), F.expr(dense)))
    out = out.withColumn("kept", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.expr(kept)))
    text, n = F.array_join("kept", "\n"), [F.size("lines").cast("long"), (F.size("lines") - F.size("kept")).cast("long")]
    columns = [text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*columns, n[0].alias("n_lines"), n[1].alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without repeated lines, plus n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of min_chars code points or
    more in min_docs documents or more lose their lines except in the largest doc_id. Nulls: a null text is empty (one
    empty line, kept), a null doc_id is one document that never owns a line that others hold. Repeated rows (same doc_id
    and text) count as one document and lose the same lines. Columns named n_lines or n_dropped give way. An empty table
    gives an empty one.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped and the hash of what is kept. Edge cases as in dedup_lines."""
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_TRIM}), '{UPPER}', '{LOWER}') AS k FROM lines),
owners AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (SELECT doc_id, pos, line, owner IS NULL OR owner = doc_id AS keep FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT keep)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
