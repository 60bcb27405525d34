"""Pooling of token grids: a row's tokens stay in its row.

Tokens are an array of arrays (token, feature), in the order time, height, width. Bins
and crops are sums over boxes of that grid, taken from sums that are cumulated once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean_tokens(tokens: Column, dim: int) -> Column:
    """The mean of all tokens."""
    return _mean(tokens, dim)


def _mean(tokens: Column, dim: int, n: Column | None = None) -> Column:
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(tokens, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double")))
    n = F.size(tokens) if n is None else n
    return F.transform(total, lambda v: F.try_divide(v, n.cast("double")))


def grid_of(n: int, times: tuple[int, ...] = (16, 8, 32, 12, 24)) -> tuple[int, int]:
    """(time steps, side) of n tokens: the first number of steps that leaves squares."""
    for t in times:
        if n % t == 0 and math.isqrt(n // t) ** 2 == n // t:
            return t, math.isqrt(n // t)
    raise ValueError(f"{n} tokens are no time steps of squares")


def bins(n: int, out: int, overlapping: bool) -> list[tuple[int, int]]:
    """Ranges of n places for ``out`` bins: cut at truncated even steps, or from the floor
    of a bin's start to the ceiling of its end, which may overlap."""
    if overlapping:
        return [(k * n // out, -(-(k + 1) * n // out)) for k in range(out)]
    cuts = [int(k * n / out) for k in range(out + 1)]
    return [(a, max(b, a + 1)) for a, b in zip(cuts, cuts[1:], strict=False)]


def grid_side(per_step: int) -> int:
    """Side of the square that the tokens of a step are; if all but one are a square, the
    first stands for the whole and isn't of it."""
    side = math.isqrt(per_step - 1) if per_step > 1 else 1
    side = side if per_step > 1 and side * side == per_step - 1 else math.isqrt(per_step)
    if per_step - side * side not in (0, 1):
        raise ValueError(f"{per_step} tokens are no square")
    return side


def cumulated(grid: np.ndarray) -> np.ndarray:
    """Sums of a grid (time, height, width, feature) up to each place, from 0 on."""
    out = np.zeros([n + 1 for n in grid.shape[:3]] + [grid.shape[3]])
    np.cumsum(grid, axis=0, dtype=np.float64, out=out[1:, 1:, 1:])
    np.cumsum(out, axis=1, out=out)
    np.cumsum(out, axis=2, out=out)
    return out


def bin_means(grid: np.ndarray, first: int, last: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Means of the bins (ranges of rows by ranges of columns) over the time steps from ``first``
    until ``last``, by eight look-ups in the cumulated sums for each."""
    sums = cumulated(grid)
    part = sums[last] - sums[first]
    lo, hi = (np.array(x) for x in zip(*ranges, strict=True))
    total = part[np.ix_(hi, hi)] - part[np.ix_(lo, hi)] - part[np.ix_(hi, lo)] + part[np.ix_(lo, lo)]
    size = (last - first) * np.outer(hi - lo, hi - lo)
    return total / size[:, :, None]


def pooled(
    rows: DataFrame, tokens: str, *keep: str, per_step: int | None = None, out: int | None = 3, overlapping: bool = False, first: str | None = None, last: str | None = None, name: str = "pooled"
) -> DataFrame:
    """The columns ``keep`` and an array: means of tokens (an array of arrays of equal lengths)
    over out × out bins of the grid of a time step, by row and column of bins, and over the
    time steps from the column ``first`` until ``last`` (all, if they aren't given); or, if
    ``out`` is None, over all tokens of these steps. ``per_step`` are the tokens of a time
    step, or of an image; grid_of() tells it by their number if it isn't given. Bins are cut
    at truncated even steps, or ``overlapping``. Null tokens, and no tokens, give null.

    Rows are Arrow lists; a grid is cumulated once a row, and nothing else is copied."""
    ends = [F.col(c).cast("int").alias(n) if c else F.lit(None).cast("int").alias(n) for c, n in ((first, "_first"), (last, "_last"))]
    kept = rows.select(*keep, *ends, F.col(tokens).alias("_tokens"))
    fields = [*kept.schema.fields[:-3], T.StructField(name, T.ArrayType(T.DoubleType()))]

    def one(x: pa.ListScalar, a: int | None, b: int | None) -> np.ndarray | None:
        if not x.is_valid or not len(x.values):
            return None
        n = len(x.values)
        each = per_step or (n // grid_of(n)[0] if out else n)
        flat = x.values.flatten().to_numpy(zero_copy_only=False)
        if n % each or len(flat) % n:
            raise ValueError(f"{n} tokens with {len(flat)} numbers are no time steps of {each}")
        grid = flat.reshape(n // each, each, -1)
        a, b = max(0, a or 0), len(grid) if b is None else min(b, len(grid))
        if a >= b:
            return None
        if out is None:
            return grid[a:b].mean(axis=(0, 1), dtype=np.float64)
        side = grid_side(each)
        square = grid[:, each - side * side :].reshape(len(grid), side, side, -1)
        return bin_means(square[a:b], 0, b - a, bins(side, out, overlapping)).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1)
            ends = [b.column(b.num_columns - k).to_pylist() for k in (3, 2)]
            means = [one(x[k], p, q) for k, (p, q) in enumerate(zip(*ends, strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(means, pa.list_(pa.float64()))], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def crop_pooled(rows: DataFrame, tokens: str, *keep: str, rel_start: Column, rel_end: Column, length: float, steps: int, per_step: int, name: str = "pooled") -> DataFrame:
    """Tokens of a window of ``length``, cropped to the time steps, or images, that stand for a
    part of it, as means over 3 × 3 adaptive bins of the grid."""
    grid_side(per_step)
    first, last = token_range(rel_start, rel_end, length, steps)
    d = rows.select(*keep, first.alias("_from"), last.alias("_until"), F.col(tokens).alias("_whole"))
    return pooled(d, "_whole", *keep, per_step=per_step, overlapping=True, first="_from", last="_until", name=name)


def token_range(rel_start: Column, rel_end: Column, length: float, steps: int) -> tuple[Column, Column]:
    """Time steps (from, to) that stand for a part of a window: ends rounded in proportion,
    one step at least."""
    first = F.least(F.lit(steps - 1).cast("long"), F.rint(rel_start / length * steps).cast("long"))
    last = F.least(F.lit(steps).cast("long"), F.greatest(first + 1, F.rint(rel_end / length * steps).cast("long")))
    return first, last


def cropped(tokens: Column, first: Column, last: Column, per_step: int) -> Column:
    """The tokens of time steps from ``first`` until ``last``."""
    return F.slice(tokens, (first * per_step + 1).cast("int"), ((last - first) * per_step).cast("int"))


def without_class_token(tokens: Column, n: int) -> tuple[Column, int]:
    """Tokens of an image without the leading one that stands for the whole, if leaving it
    out gives a square."""
    if n > 1 and math.isqrt(n - 1) ** 2 == n - 1:
        return F.slice(tokens, 2, n - 1), n - 1
    return tokens, n
