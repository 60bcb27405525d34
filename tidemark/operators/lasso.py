"""Lasso regression from sums of products, with blocks of targets as tasks.

Features are standardised, so a fit needs their correlations C (d × d) and their products
with the targets G (d × p) only. Penalties go down from where all coefficients are 0 to
the one that is wanted. At each, only the features of an active set are looked at, by
coordinate descent for all targets of a block together; then the optimality conditions
are checked for all features, and those that break them join the set.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import new_path

CONVERGED = 1e-6  # largest breach of the optimality conditions


def _shrunk(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def breach(w: np.ndarray, rest: np.ndarray, alpha: float) -> float:
    """By how much coefficients miss the optimality conditions: what is left of the products is
    alpha with the sign of a coefficient that isn't 0, and within alpha of 0 elsewhere."""
    off = np.where(w != 0, np.abs(rest - alpha * np.sign(w)), np.maximum(np.abs(rest) - alpha, 0))
    return float(off.max(initial=0))


def descend(c: np.ndarray, g: np.ndarray, alpha: float, w: np.ndarray, tol: float, rounds: int) -> np.ndarray:
    """Coordinate descent on features whose deviation isn't 0, from ``w`` on."""
    rest = g - c @ w
    for _ in range(rounds):
        for j in range(len(c)):
            new = _shrunk(rest[j] + c[j, j] * w[j], alpha) / c[j, j]
            step = new - w[j]
            if step.any():
                rest -= np.outer(c[:, j], step)
                w[j] = new
        if breach(w, rest, alpha) < tol:
            break
    return w


def lasso_block(c: np.ndarray, g: np.ndarray, alpha: float, tol: float = 1e-9, rounds: int = 5000) -> tuple[np.ndarray, float]:
    """(coefficients d × p, breach of the optimality conditions) that minimise wᵀCw / 2 - gᵀw +
    alpha * |w| for each column of ``g``. Features with a deviation of 0 get 0."""
    w, usable = np.zeros_like(g), np.diag(c) > 1e-12
    top = float(np.abs(g[usable]).max(initial=0))
    if top <= alpha:
        return w, 0.0
    least = max(alpha, top * 1e-6)
    path = np.geomspace(top, least, max(2, int(np.ceil(np.log2(top / least))) + 1))[1:].tolist()
    path[-1] = alpha
    active = np.zeros(len(c), bool)
    rest = g.copy()
    for a in path:
        end = a == path[-1]
        while True:
            more = usable & ~active & (np.abs(rest) > a * (1 + 1e-12) + (tol if end else 0)).any(axis=1)
            if not more.any() and active.any() and breach(w[active], rest[active], a) < (tol if end else a * 1e-2):
                break
            active |= more
            if not active.any():
                break
            at = np.flatnonzero(active)
            own = descend(c[np.ix_(at, at)], g[at], a, w[at], tol if end else a * 1e-3, rounds if end else 50)
            w[at] = own
            rest = g - c[:, at] @ own
            if not more.any():
                break  # as far as rounding and rounds let it come
        active &= (w != 0).any(axis=1)
    return w, breach(w[usable], rest[usable], alpha)


def standardised(n: float, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, ...]:
    """(mean of X, its population deviation, correlations, products with Y) by n rows."""
    d = len(sx)
    mean = sx / n
    c = xx.reshape(d, d) / n - np.outer(mean, mean)
    g = xy.reshape(d, -1) / n - np.outer(mean, sy / n)
    std = np.sqrt(np.maximum(np.diag(c), 0))
    std[std <= 1e-12] = 1.0
    return mean, std, c / np.outer(std, std), g / std[:, None]


@lru_cache(maxsize=1)
def _sums_at(path: str, by: str, key) -> tuple[np.ndarray, ...]:
    """Of one group the number of its rows, the sums of Y, and what standardised() returns."""
    store, root = fs.FileSystem.from_uri(path)
    wanted = dataset.field(by).is_null() if key is None else dataset.field(by) == key
    t = dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=["part", "i", "v"], filter=wanted).to_pandas().sort_values(["part", "i"])
    n, sx, sy, xx, xy = (np.frombuffer(b"".join(t.v[t.part == k]), "<f8") for k in range(5))
    return n[0], sy, *standardised(n[0], sx, sy, xx, xy)


def lasso_fits(sums: DataFrame, by: str, alpha: float, targets: int = 64) -> DataFrame:
    """(by, w, b, converged, breach) from sums (by, part, i, v) as regression.gram() makes them: a
    task has ``targets`` targets of a group at a time, and reads its sums from the shared
    folder. Fits are put together by group at the end."""
    path = new_path(sums.sparkSession, "sums")
    sums.select(by, "part", "i", "v").repartition(by).sortWithinPartitions(by, "part", "i").write.parquet(path)
    stored = sums.sparkSession.read.parquet(path)
    n = stored.where("part = 2").groupBy(by).agg((F.sum(F.length("v")) / 8).cast("int").alias("_p"))
    blocks = n.select(by, F.explode(F.sequence(F.lit(0), F.ceil(F.col("_p") / targets).cast("int") - 1)).alias("block"))
    kind = f"`{by}` {stored.schema[by].dataType.simpleString()}"

    def solve(batches):
        for pdf in batches:
            out = []
            for key, block in zip(pdf[by].tolist(), pdf["block"].tolist(), strict=True):
                _, sy, mean, std, c, g = _sums_at(path, by, None if key != key else key)
                own = slice(block * targets, (block + 1) * targets)
                w, off = lasso_block(c, g[:, own].copy(), alpha)
                w /= std[:, None]
                out.append((key, block, w.ravel().tolist(), w.shape[1], (sy[own] / _sums_at(path, by, None if key != key else key)[0] - mean @ w).tolist(), off))
            yield pd.DataFrame(out, columns=[by, "block", "w", "p", "b", "breach"])

    # Few rows, each of much work: one task for each.
    parts = blocks.repartition(max(1, blocks.count())).mapInPandas(solve, f"{kind}, block int, w array<double>, p int, b array<double>, breach double")

    def together(key, pdf):
        pdf = pdf.sort_values("block")
        w = np.concatenate([np.asarray(x).reshape(-1, p) for x, p in zip(pdf.w, pdf.p, strict=True)], axis=1)
        off = float(pdf.breach.max())
        return pd.DataFrame([(*key, w.ravel().tolist(), np.concatenate(pdf.b.tolist()).tolist(), off < CONVERGED, off)], columns=[by, "w", "b", "converged", "breach"])

    return parts.groupBy(by).applyInPandas(together, f"{kind}, w array<double>, b array<double>, converged boolean, breach double")
