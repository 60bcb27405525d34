"""Sums of large matrices, shuffled and added up in tiles of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 8192  # numbers that are shuffled and added up together


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) != len(column) * len(column[0]):
        raise ValueError("rows of one group have different numbers of features or responses")
    return flat.reshape(len(column), -1)


def grouped(b: pa.RecordBatch, by: tuple[str, ...]) -> list[tuple[tuple, np.ndarray]]:
    """(key, places of its rows) of each group of a batch."""
    code = np.zeros(b.num_rows, np.int64)
    for c in by:
        column = b.column(b.schema.get_field_index(c)).dictionary_encode()
        code = code * (len(column.dictionary) + 1) + column.indices.fill_null(len(column.dictionary)).to_numpy(zero_copy_only=False)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(first) + 1))
    return [(tuple(b.column(b.schema.get_field_index(c))[int(k)].as_py() for c in by), order[x:y]) for k, x, y in zip(first, cuts, cuts[1:], strict=False)]


def added(tiles: DataFrame, *by: str) -> DataFrame:
    """Tiles (by, part, i, v) of equal keys added up. Each task numbers what it hands on, and
    tiles of a key are added in that order, so that sums don't change from run to run."""
    keys = [*by, "part", "i"]
    d = tiles.select(*keys, "v", F.spark_partition_id().alias("_task"))
    d = d.repartition(*keys).sortWithinPartitions(*keys, "_task").select(*keys, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None  # the key of the tile that is added to, as a batch of one row

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*last.columns, pa.array([total.tobytes()], pa.binary())], names=[*keys, "v"])

        for b in batches:
            if not b.num_rows:
                continue
            own = b.select(keys)
            differs = np.ones(b.num_rows, bool)
            differs[1:] = ~_same(own.slice(0, b.num_rows - 1), own.slice(1))
            if last is not None:
                differs[0] = not _same(last, own.slice(0, 1))[0]
            values = b.column(len(keys))
            for k, new in enumerate(differs):
                v = np.frombuffer(values[k].as_buffer(), "<f8")
                if new:
                    if last is not None:
                        yield out()
                    last, total = own.slice(k, 1), v.copy()
                else:
                    total += v
        if last is not None:
            yield out()

    return d.mapInArrow(run, d.schema)


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> np.ndarray:
    """Whether rows are equal, of which null and null are."""
    same = np.ones(a.num_rows, bool)
    for x, y in zip(a.columns, b.columns, strict=True):
        equal = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False)
        same &= equal | (x.is_null().to_numpy(zero_copy_only=False) & y.is_null().to_numpy(zero_copy_only=False))
    return same
