"""Vectors of integers: components scaled, rounded down and packed; exact products and distances of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import own

#: Components are under this in absolute value, so that 64 bits hold every product and squared distance of up to 256 of them.
MOST = 1 << 27


def whole(rows: pa.Array, scale: int, length: int | None) -> tuple[np.ndarray, list[bytes]]:
    """Which vectors are kept, and floor(scale * x) of their components as packed 32-bit integers."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.fill_null(pc.cast(rows.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    end = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    keep = pc.is_valid(rows).to_numpy(zero_copy_only=False) & (wrong[end] == wrong[end - sizes])
    if length is not None:
        keep &= sizes == length
    q = np.floor(np.where(np.isfinite(x), x, 0.0) * scale)
    kept = np.repeat(keep, sizes)
    if len(q) and np.abs(q[kept]).max(initial=0) >= MOST:
        raise ValueError(f"a component is {MOST / scale:.0f} or more in absolute value")
    packed = q[kept].astype("<i4").tobytes()
    cut = np.concatenate([[0], np.cumsum(sizes[keep])]) * 4
    return keep, [packed[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def integer_vectors(rows: DataFrame, scale: int, id: str = "vec_id", vector: str = "embedding", length: int | None = None) -> DataFrame:
    """(vec_id, key): the rows whose vector, and each component of it, is neither null nor non-finite; key packs
    floor(scale * x) of the components. length: the number of components that rows must have, if any. A component too
    large for exact results is an error, never a wrong result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, packed = whole(batch.column(1), scale, length)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(packed, pa.binary())], names=["vec_id", "key"])

    return rows.select(own(id).cast("long").alias("vec_id"), own(vector)).mapInArrow(work, "vec_id long, key binary")


def unpacked(packed: list[bytes], width: int) -> np.ndarray:
    """A row of integers for each vector: cut, or filled up with zeros, to a width."""
    if all(len(p) == 4 * width for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), width).astype(np.int64)
    out = np.zeros((len(packed), width), np.int64)
    for row, p in zip(out, packed, strict=True):
        row[: len(p) // 4] = np.frombuffer(p, "<i4")[:width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: in floating point where that holds every partial sum, else in 64-bit integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
