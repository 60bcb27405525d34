"""Clustering by centroids, with distances that are bounded by a table of pivots (LAESA).

Each vector's distances to a few fixed pivots are stored once. In every round the
centroids' distances to the pivots are taken; by the triangle inequality the largest
difference of both bounds a vector's distance to a centroid from below. A vector looks
at centroids in the order of their bounds, takes exact integer distances, and stops at
the first bound beyond the best distance so far. Tasks add their vectors up by
centroid; what is gathered is one row a centroid.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vectors import blocks, exact, whole

NUMBERS = 1 << 20  # numbers of vectors that are looked at together
LONGEST = (1 << 63) - 1


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different vectors of a sample, each the farthest from those before it."""
    chosen = [0][: len(sample)]
    if not chosen:
        return sample[:0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors to pivots, as doubles."""
    return np.sqrt(np.stack([((v - p) ** 2).sum(axis=1) for p in pivots], axis=1).astype(np.float64)) if len(pivots) else np.zeros((len(v), 0))


def nearest(v: np.ndarray, table: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, of equals the first; squared distance; distances that were taken).
    ``table`` and ``of_centroids`` are the distances of vectors and centroids to the pivots."""
    bound = np.zeros((len(v), len(centroids)))
    for k in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, k, None] - of_centroids[None, :, k]), out=bound)
    # Roots are rounded: a bound is taken a little lower, so that it is never too high.
    bound = np.maximum(bound * (1 - 1e-12) - 1e-6, 0.0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    largest = int(np.abs(v).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    kind = exact(v.shape[1] * largest**2) if largest else np.int64
    x, c = v.astype(kind), centroids.astype(kind)
    best, at, taken = np.full(len(v), np.inf if kind is not np.int64 else LONGEST, np.float64 if kind is not np.int64 else np.int64), np.full(len(v), len(centroids)), 0
    alive = np.arange(len(v))
    for k in range(len(centroids)):
        j = order[alive, k]
        go = bound[alive, j] <= best[alive]  # the bounds to come are not lower
        alive, j = alive[go], j[go]
        if not len(alive):
            break
        apart = x[alive] - c[j]
        d = np.einsum("ij,ij->i", apart, apart).astype(best.dtype)
        taken += len(d)
        less = (d < best[alive]) | (d == best[alive]) & (j < at[alive])
        best[alive[less]], at[alive[less]] = d[less], j[less]
    return at, best.astype(np.int64), taken


def centroid_clusters(
    rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, pivots: int = 8, sample: int = 512
) -> DataFrame:
    """One row per vector that is kept: vec_id, cluster, distance (squared), cluster_inertia
    and inertia (distances summed over the cluster and over all), centroid_sha256 (of the
    components of the cluster's final centroid as decimal integers, joined by commas).

    Kept are vectors of exactly ``dims`` components, none null or not finite; others are in
    no row. They are taken as integers floor(scale * x), held within 2^26 on both sides.
    The first centroids are the k kept vectors with the least sha256 of ``seed:vec_id`` (fewer
    if there are fewer vectors); of equal ids the lesser vectors come first, and rows
    without id last. Repeated rows are vectors like others, and get equal results. An
    empty table gives an empty one; further columns aren't read. Sums that don't fit into
    a long are given as the largest one.

    Pivots are ``pivots`` vectors that lie apart, of the ``sample`` vectors with the least
    hashes; results don't depend on them.
    """
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole(rows, vector, scale, dims).alias("v")).where("v is not null")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dims)
    drawn = kept.orderBy(F.xxhash64("vec_id", "v"), "v").limit(sample).collect()
    apart = spread_out(np.array([r.v for r in drawn], np.int64).reshape(len(drawn), dims), pivots)

    def stored(batches):
        for (ids,), v in blocks(batches, 1, NUMBERS):
            table = to_pivots(v, apart)
            own = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(t)) if x.shape[1] else pa.array([[]] * len(v), pa.list_(t)) for x, t in ((v.astype(np.int32), pa.int32()), (table, pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids, *own], names=["vec_id", "v", "pivots"])

    d = written(kept.mapInArrow(stored, "vec_id long, v array<int>, pivots array<double>"), "pivot-table")

    def looked_at(batches, centroids):
        of_centroids = to_pivots(centroids, apart)
        for (ids, table), v in blocks(batches, 1, NUMBERS):
            table = table.flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(apart))
            yield (ids, v, *nearest(v, table, centroids, of_centroids))

    def moved(centroids: np.ndarray) -> np.ndarray:
        def run(batches):
            n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
            for _, v, at, _, _ in looked_at(batches, centroids):
                order = np.argsort(at, kind="stable")
                own, starts = np.unique(at[order], return_index=True)
                n[own] += np.diff(np.append(starts, len(at)))
                sums[own] += np.add.reduceat(v[order], starts, axis=0)
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), *[pa.array(sums[own, i]) for i in range(dims)]], names=["cluster", "n", *names])

        names = [f"s{i}" for i in range(dims)]
        parts = d.mapInArrow(run, ", ".join(["cluster int, n long", *[f"{s} long" for s in names]]))
        total = parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)])
        out = centroids.copy()
        for r in total.collect():  # one row a centroid
            out[r.cluster] = [int(r[s]) // int(r.n) for s in names]
        return out

    for _ in range(rounds):
        centroids = moved(centroids)

    def run(batches):
        for ids, _, at, best, _ in looked_at(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(best)], names=["vec_id", "cluster", "distance"])

    last = written(d.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r.cluster: int(r.s) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    fit = lambda x: min(int(Decimal(x)), LONGEST)
    names = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in sums}
    of = rows.sparkSession.createDataFrame([(c, fit(s), fit(sum(sums.values())), names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
