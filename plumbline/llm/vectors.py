"""Integer vectors of the embedding operators: what takes part, and how it is packed.

A row takes part if its vector is not null and holds no null or non-finite component.
Component x becomes floor(256 * x), x as double. Vectors are as wide as the longest one
that takes part; shorter ones are filled up with zeros, so an empty vector is all zeros.
Integers that would overflow exact arithmetic are an error, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: Column) -> Column:
    """True where the vector is there and every component is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def extent(kept: DataFrame, vector: str) -> tuple[int, int]:
    """Width of the longest vector and the largest absolute integer component; one small row reaches the driver."""
    far = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    row = kept.agg(F.max(F.size(vector)).alias("width"), F.max(far).alias("far")).first()
    return int(row.width or 0), int((row.far or 0.0) * SCALE) + 1


def exact_type(width: int, far: int) -> type:
    """The number type in which sums of width products of components are exact: doubles (for BLAS) or 64-bit integers."""
    most = 4 * max(1, width) * far * far  # differences are at most twice a component
    if most < 1 << 53:
        return np.float64
    if most < 1 << 62 and far < 1 << 31:
        return np.int64
    raise ValueError(f"vectors of {width} components up to {far} overflow 64-bit inner products")


def integers(rows: DataFrame, vector: str, width: int, out: str = "v") -> DataFrame:
    """rows with the vector column replaced by its integers: width little-endian int32 in one binary column."""
    names = [c for c in rows.columns if c != vector]
    picked = rows.select(*names, F.transform(vector, lambda x: x.cast("double")).alias("x__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(len(names))
            n, flat = len(col), np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
            size = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            x = np.zeros((n, width), np.int32)
            row = np.repeat(np.arange(n), size)
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(SCALE * flat)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], binaries(x)], names=[*names, out])

    return picked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + f", {out} binary")


def binaries(x: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    x = np.ascontiguousarray(x)
    n, size = len(x), x.dtype.itemsize * int(np.prod(x.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(x.tobytes())])


def matrix(col: pa.Array | pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """The rows of a binary column of equal sizes as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col) or not width:
        return np.zeros((len(col), width), dtype)
    raw = col.cast(pa.large_binary())
    start = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    return np.frombuffer(raw.buffers()[2], np.uint8)[start[0] : start[-1]].view(dtype).reshape(len(raw), width)
