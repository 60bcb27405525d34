"""Vectors as integers, as the operators on embeddings take them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 26  # components are held within this, so that products of them fit into 64 bits


def whole(rows: DataFrame, vector: str, scale: int, dims: int | None = None) -> Column:
    """floor(scale * x) of each component x as double; null for vectors that are null, hold
    null or a number that isn't finite, or haven't ``dims`` components, if that is given."""
    v = F.col(vector)
    fits = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    if dims is not None:
        fits = fits & (F.size(v) == dims)
    held = lambda x: F.least(F.lit(float(MOST)), F.greatest(F.lit(-float(MOST)), F.lit(float(scale)) * x.cast("double")))
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(v, lambda x: F.floor(held(x)).cast("int")))


def blocks(batches: Iterator[pa.RecordBatch], vector: int, numbers: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """(other columns, matrix) of rows with an array of integers, put together to matrices of
    at most about ``numbers`` numbers; shorter vectors are filled up with zeros, and a
    longer one than that is alone."""
    held: list[pa.RecordBatch] = []
    rows = widest = 0
    for b in batches:
        n = b.column(vector).value_lengths().to_numpy(zero_copy_only=False) if b.num_rows else np.empty(0, np.int64)
        at = 0
        while at < b.num_rows:
            wide = np.maximum.accumulate(np.maximum(n[at:], max(widest, 1)))
            fit = int(np.count_nonzero(wide * (rows + np.arange(1, len(wide) + 1)) <= numbers))
            if fit or not rows:
                fit = max(1, fit)
                held.append(b.slice(at, fit))
                rows, widest, at = rows + fit, int(wide[fit - 1]), at + fit
            if at < b.num_rows:
                yield _block(held, vector)
                held, rows, widest = [], 0, 0
    if held:
        yield _block(held, vector)


def _block(held: list[pa.RecordBatch], vector: int) -> tuple[list[pa.Array], np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    v = t.column(vector).combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    n, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    widest = int(n.max()) if len(n) else 0
    if (n == widest).all():
        m = flat.reshape(len(n), widest).astype(np.int64)
    else:
        m = np.zeros((len(n), widest), np.int64)
        row = np.repeat(np.arange(len(n)), n)
        m[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return [t.column(k).combine_chunks() for k in range(t.num_columns) if k != vector], m


def exact(bound: int) -> type:
    """The fastest kind of number in which sums of products up to ``bound`` are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
