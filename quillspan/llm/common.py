"""What the training-data operators share: reading tables, scratch tables, names and Arrow batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words.
SPACES = " \t\n\x0b\x0c\r"
#: A word, in Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's spark.checkpoint.dir.

    A local master may do without: its only machine has a temporary folder. A cluster must name one that all share.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.startswith("local"):
        return f"{tempfile.gettempdir()}/quillspan-{spark.sparkContext.applicationId}"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


#: Tables that this thread of the driver has written and not yet removed, oldest first: one thread's don't concern another's.
_mine = threading.local()


def _written() -> list[str]:
    if not hasattr(_mine, "paths"):
        _mine.paths = []
    return _mine.paths


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: later stages survive lost executors without computing df again. The table stays, for the result
    is read later; clear_scratch() removes what is no longer needed.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/quillspan-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A point in the list of tables, for clear_scratch()."""
    return len(_written())


def clear_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the tables written since a mark, but for the last keep of them."""
    written = _written()
    gone = written[since : len(written) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    written[since : len(written) - keep] = []


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast built-in; elsewhere É must stay É."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def own(name: str) -> Column:
    """A column of a table by its name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(docs: DataFrame, name: str) -> str:
    """A name that no column of docs starts with, in any case."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def as_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one struct column, row, beside columns made of them: no name in docs can clash. select("row.*") gives them back."""
    return docs.select(F.struct(*[own(c) for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns at the end. One of that name (in any case) in df gives way."""
    clash = {c.lower() for c in columns}
    return df.select(*[own(c) for c in df.columns if c.lower() not in clash], *[v.alias(k) for k, v in columns.items()])


def slim_batches(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about max_bytes of text (one row at least)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(
    docs: DataFrame, fn: Callable[[list[str]], list[pa.Array]], to: dict[str, tuple[str, pa.DataType]],
    text: str = "text", keep: list[str] | None = None, max_bytes: int = 1 << 22, setup: Callable[[], None] | None = None,
) -> DataFrame:
    """docs with columns that fn makes of a text column, in batches of bounded size; a null text comes as "".

    keep: the columns of docs to return, all by default. Columns named as the results give way.
    """
    results = {k.lower() for k in to}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    body = free_name(docs, "text_")
    inner = docs.select(*[own(c) for c in kept], own(text).alias(body))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in slim_batches(batches, body, max_bytes):
            made = fn([t or "" for t in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *made], names=[*kept, *to])

    fields = ["`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in inner.schema if f.name in kept] + [f"`{k}` {v[0]}" for k, v in to.items()]
    return inner.mapInArrow(work, ", ".join(fields))


_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, ASCII white space alone


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def shingle_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, rolled up from the words' hashes; for the whole sequence if it has fewer; none of none."""
    n = min(n, len(hashed))
    if not n:
        return np.zeros(0, np.uint64)
    size = len(hashed) - n + 1
    out = hashed[:size].copy()
    for i in range(1, n):
        out *= _P
        out += hashed[i : size + i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def span_text(spans: Column) -> Column:
    """Spans (start, end, kind, ...) in their order as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
