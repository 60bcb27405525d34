"""Ridge and lasso regression of responses on features.

Rows have features X (an array) and responses Y (an array). A fit needs sums over rows
only: each task adds up the products of its rows, and hands them on in tiles, which are
added up by group. What is solved on one machine is a matrix as wide as the features,
or, where a group has fewer rows than features, as its rows: both numbers are measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.kernels import complete
from tidemark.operators.lasso import lasso_fits
from tidemark.operators.tiles import TILE, added, grouped, matrix
from tidemark.sources.storage import new_path, written

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


def _kinds(rows: DataFrame, by: tuple[str, ...]) -> list[str]:
    return [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by]


def gram(rows: DataFrame, *by: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, part, i, v): per group the sums that a fit needs, in tiles of numbers. part 0 is
    the number of rows, 1 and 2 the sums of X and Y, 3 the products XᵀX, 4 XᵀY, 5 the
    squares of Y. Each task adds up its own rows first, so what is shuffled doesn't grow
    with the rows. Groups may have numbers of features and responses of their own. Rows
    with an array that is null, or holds null or NaN, take no part; part 0 counts the others."""
    full = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).where(complete("_x", "_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for key, at in grouped(b, by):
                own = b.take(pa.array(at))
                a, c = matrix(own.column(len(by))), matrix(own.column(len(by) + 1))
                parts = [np.array([len(a)], float), a.sum(0), c.sum(0), (a.T @ a).ravel(), (a.T @ c).ravel(), (c * c).sum(0)]
                if key in sums:
                    for s, p in zip(sums[key], parts, strict=True):
                        s += p
                else:
                    sums[key] = parts
        for key, parts in sums.items():
            for n, p in enumerate(parts):
                tiles = [p[at : at + TILE].astype("<f8").tobytes() for at in range(0, len(p), TILE)]
                cols = [pa.array([v] * len(tiles), k) for v, k in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([n] * len(tiles), pa.int32()), pa.array(range(len(tiles)), pa.int64()), pa.array(tiles, pa.binary())], names=[*by, "part", "i", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema[c].dataType) for c in by]
    return added(full.mapInArrow(run, ", ".join([*_kinds(rows, by), "part int, i long, v binary"])), *by)


def _sums(pdf) -> list[np.ndarray]:
    """The sums of one group, from its tiles."""
    pdf = pdf.sort_values(["part", "i"])
    return [np.frombuffer(b"".join(pdf.v[pdf.part == k]), "<f8") for k in range(6)]


def solve_primal(n: float, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray, alpha: float, scale: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients d × p, intercepts p) from the sums; ``scale`` divides X by its
    population deviation, of which 0 counts as 1."""
    d = len(sx)
    mean = sx / n
    xtx = xx.reshape(d, d) - n * np.outer(mean, mean)
    xty = xy.reshape(d, -1) - np.outer(mean, sy)
    std = np.sqrt(np.maximum(np.diag(xtx), 0) / n) if scale else np.ones(d)
    std[std <= 1e-12] = 1.0
    w = np.linalg.solve(xtx / np.outer(std, std) + alpha * np.eye(d), xty / std[:, None]) / std[:, None]
    return w, sy / n - mean @ w


def solve_dual(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The same from the rows, by a matrix as wide as there are rows."""
    mx, my = x.mean(0), y.mean(0)
    a = x - mx
    w = a.T @ np.linalg.solve(a @ a.T + alpha * np.eye(len(a)), y - my)
    return w, my - mx @ w


def ridge_fit(rows: DataFrame, *by: str, alpha: float = 1000.0, scale: bool = False, form: str | None = None, most_numbers: int = 8_000_000) -> DataFrame:
    """(by, w, b): per group the coefficients (an array of d * p numbers, by feature) and
    the intercepts. Groups with fewer rows than features, and at most ``most_numbers`` of
    them, are solved from their rows, all others from the sums of products; ``form`` ("rows"
    or "sums") decides instead of these counts. For very many features see kernel_ridge()."""
    kinds = _kinds(rows, by)
    schema = ", ".join([*kinds, "w array<double>, b array<double>"])

    def out(key: tuple, w: np.ndarray, b: np.ndarray):
        return pd.DataFrame([(*key, w.ravel().tolist(), b.tolist())], columns=[*by, "w", "b"])

    def from_rows(key, pdf):
        return out(key, *solve_dual(np.stack(pdf.x.to_numpy()).astype(float), np.stack(pdf.y.to_numpy()).astype(float), alpha))

    def from_sums(key, pdf):
        n, sx, sy, xx, xy, _ = _sums(pdf)
        return out(key, *solve_primal(n[0], sx, sy, xx, xy, alpha, scale))

    by_rows = lambda d: d.select(*by, "x", "y").where(complete("x", "y")).groupBy(*by).applyInPandas(from_rows, schema)
    by_sums = lambda d: gram(d, *by).groupBy(*by).applyInPandas(from_sums, schema)
    if form or scale or not by:
        return by_rows(rows) if form == "rows" else by_sums(rows)
    sizes = rows.where(complete("x", "y")).groupBy(*by).agg(F.count("*").alias("_n"), F.max(F.size("x")).alias("_d"))
    sizes = written(sizes.select(*by, ((F.col("_n") < F.col("_d")) & (F.col("_n") * F.col("_d") <= most_numbers)).alias("_few")), "sizes")
    kinds_of = {r["_few"] for r in sizes.select("_few").distinct().collect()}
    if kinds_of <= {False}:
        return by_sums(rows)
    few = by_rows(rows.join(sizes.where("_few"), list(by), "left_semi"))
    return few if kinds_of == {True} else few.union(by_sums(rows.join(sizes.where("not _few"), list(by), "left_semi")))


@lru_cache(maxsize=4)
def _table_at(path: str, columns: tuple[str, ...], by: tuple[str, ...]) -> dict[tuple, tuple]:
    store, root = fs.FileSystem.from_uri(path)
    own = dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=[*by, *columns])
    keys = zip(*[own.column(c).to_pylist() for c in by], strict=True) if by else [()] * own.num_rows
    return {k: tuple(_numbers(own.column(c)[i]) for c in columns) for i, k in enumerate(keys)}


@lru_cache(maxsize=4)
def _row_at(path: str, columns: tuple[str, ...], by: tuple[str, ...], key: tuple) -> tuple | None:
    store, root = fs.FileSystem.from_uri(path)
    own = dataset.dataset(root, filesystem=store, format="parquet")
    wanted = None
    for c, v in zip(by, key, strict=True):
        test = dataset.field(c).is_null() if v is None else dataset.field(c) == v
        wanted = test if wanted is None else wanted & test
    found = own.to_table(columns=list(columns), filter=wanted)
    return tuple(_numbers(found.column(c)[0]) for c in columns) if found.num_rows else None


def _numbers(x: pa.Scalar):
    """Arrays of numbers as they lie there, other values as Python's."""
    return x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) and x.is_valid else x.as_py()


class Fits:
    """Rows of a small table by key, for the tasks: it is written to the shared folder, and
    worker processes read it from there, whole up to ``most`` numbers and row by row
    beyond. The driver gets one number."""

    def __init__(self, fits: DataFrame, by: tuple[str, ...], columns: tuple[str, ...], most: int):
        spark, self.by, self.columns = fits.sparkSession, by, columns
        self.path = new_path(spark, "fits")
        fits.select(*by, *columns).write.parquet(self.path)
        sizes = sum((F.size(c) for c in columns if isinstance(fits.schema[c].dataType, T.ArrayType)), F.lit(0))
        self.whole = (spark.read.parquet(self.path).agg(F.sum(sizes.cast("long"))).first()[0] or 0) <= most

    def get(self, key: tuple) -> tuple | None:
        return _table_at(self.path, self.columns, self.by).get(key) if self.whole else _row_at(self.path, self.columns, self.by, key)


def predict(rows: DataFrame, fits: DataFrame, *by: str, most: int = 20_000_000) -> DataFrame:
    """Rows with p, an array: X times the coefficients of the row's group, plus the
    intercepts; null for an X that is null or holds null or NaN. Rows of groups without a fit go. Whole batches are
    multiplied."""
    known, names = Fits(fits, by, ("w", "b"), most), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, at in grouped(b, by) if b.num_rows else ():
                if (fit := known.get(key)) is None:
                    continue
                own = b.take(pa.array(at))
                x = own.column(names.index("x"))
                full = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
                p: list = [None] * len(at)
                if len(full):
                    found = matrix(x.take(pa.array(full))) @ fit[0].reshape(-1, len(fit[1])) + fit[1]
                    for i, v, ok in zip(full, found, ~np.isnan(found).any(axis=1), strict=True):
                        p[i] = v if ok else None
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(p, pa.list_(pa.float64()))], names=[*b.schema.names, "p"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))]))


def long_form(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per parcel of rows with y and p: keep, parcel, y, p."""
    both = F.posexplode(F.arrays_zip("y", "p")).alias("parcel", "_z")
    d = rows.select(*keep, both)
    return d.select(*keep, F.col("parcel").cast("long").alias("parcel"), F.col("_z.y").cast("double").alias("y"), F.col("_z.p").alias("p"))


def fold_fits(rows: DataFrame, k: int, alpha: float, model: str = "ridge", fold: str = "fold") -> DataFrame:
    """(fold, w, b, converged, and breach for lasso): for each fold the fit to all others. The
    sums of each fold are made once; those of the others are all less the fold's own."""
    sums = written(gram(rows, fold), "sums")
    every = added(sums, *()).select("part", "i", F.col("v").alias("_all"))
    both = sums.join(every, ["part", "i"]).select(fold, "part", "i", "v", "_all")

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [(np.frombuffer(q, "<f8") - np.frombuffer(p, "<f8")).tobytes() for p, q in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(v, pa.binary())], names=b.schema.names[:4])

    def fit(key, pdf):
        n, sx, sy, xx, xy, _ = _sums(pdf)
        w, b = solve_primal(n[0], sx, sy, xx, xy, alpha, scale=True)
        return pd.DataFrame([(*key, w.ravel().tolist(), b.tolist(), True)], columns=[fold, "w", "b", "converged"])

    others = both.mapInArrow(less, both.drop("_all").schema)
    if model == "lasso":
        return lasso_fits(others, fold, alpha)
    return others.groupBy(fold).applyInPandas(fit, ", ".join([*_kinds(rows, (fold,)), "w array<double>, b array<double>, converged boolean"]))


def decomposed(n: float, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, ...]:
    """(mean and deviation of X, mean of Y, directions d × d, their squared lengths, their
    products with Y) of standardised features."""
    d = len(sx)
    mean = sx / n
    xtx = xx.reshape(d, d) - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(xtx), 0) / n)
    std[std <= 1e-12] = 1.0
    length, directions = np.linalg.eigh(xtx / np.outer(std, std))
    return mean, std, sy / n, directions, np.maximum(length, 0), directions.T @ ((xy.reshape(d, -1) - np.outer(mean, sy)) / std[:, None])


def ridge_alphas(rows: DataFrame, *by: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(by, w, b, error): per group the ridge fits on standardised features for all alphas, from
    one decomposition; they are put side by side, as if there were so many times the
    responses. A group whose fit fails has the reason in error, and no fit."""

    def fit(key, pdf):
        try:
            n, sx, sy, xx, xy, _ = _sums(pdf)
            mean, std, my, directions, length, along = decomposed(n[0], sx, sy, xx, xy)
            w = np.concatenate([directions @ (along / (length + alpha)[:, None]) / std[:, None] for alpha in alphas], axis=1)
            out = (w.ravel().tolist(), (np.tile(my, len(alphas)) - mean @ w).tolist(), None)
        except (np.linalg.LinAlgError, ValueError) as e:
            out = (None, None, f"failed: {e}")
        return pd.DataFrame([(*key, *out)], columns=[*by, "w", "b", "error"])

    return gram(rows, *by).groupBy(*by).applyInPandas(fit, ", ".join([*_kinds(rows, by), "w array<double>, b array<double>, error string"]))


def left_out_errors(x: np.ndarray, y: np.ndarray, n: float, parts: tuple[np.ndarray, ...], alphas: tuple[float, ...]) -> list[float]:
    """Per alpha the sum of squared errors of these rows, each predicted without itself. The
    constant is part of the leverage."""
    mean, std, my, directions, length, xy = parts
    q, c, out = ((x - mean) / std) @ directions, y - my, []
    for alpha in alphas:
        leverage = 1 / n + (q**2) @ (1 / (length + alpha))
        rest = (c - q @ (xy / (length + alpha)[:, None])) / np.maximum(1 - leverage, 1e-12)[:, None]
        out.append(float((rest**2).sum()))
    return out


def loo_fit(rows: DataFrame, *by: str, alphas: tuple[float, ...] = ALPHAS, most: int = 20_000_000) -> DataFrame:
    """(by, alpha, mse, w, b): per group the alpha of least leave-one-out error on
    standardised features, of equals the last, and the ridge fit with it. The products
    of a group are decomposed once; a second pass over its rows, of which there may be
    any number, adds up their errors."""
    rows = rows.where(complete("x", "y"))
    names = ("mean", "std", "my", "directions", "length", "xy")

    def decompose(key, pdf):
        n, sx, sy, xx, xy, _ = _sums(pdf)
        return pd.DataFrame([(*key, float(n[0]), *[p.ravel().tolist() for p in decomposed(n[0], sx, sy, xx, xy)])], columns=[*by, "n", *names])

    parts = gram(rows, *by).groupBy(*by).applyInPandas(decompose, ", ".join([*_kinds(rows, by), "n double", *[f"{c} array<double>" for c in names]]))
    parts = written(parts, "decomposed")
    known = Fits(parts, by, ("n", *names), most)
    own = rows.select(*by, "x", "y")

    def shaped(fit: tuple) -> tuple[float, tuple[np.ndarray, ...]]:
        n, mean, std, my, directions, length, xy = fit
        return n, (mean, std, my, directions.reshape(len(mean), -1), length, xy.reshape(len(mean), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, at in grouped(b, by) if b.num_rows else ():
                part = b.take(pa.array(at))
                x, y = matrix(part.column(len(by))), matrix(part.column(len(by) + 1))
                errors = left_out_errors(x, y, *shaped(known.get(key)), alphas)
                cols = [pa.array([v] * len(alphas), k) for v, k in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(len(alphas)), pa.int32()), pa.array(errors), pa.array([float(y.size)] * len(alphas))], names=[*by, "_k", "_e", "_n"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema[c].dataType) for c in by]
    errors = own.mapInArrow(run, ", ".join([*_kinds(rows, by), "_k int, _e double, _n double"])).groupBy(*by, "_k").agg((F.sum("_e") / F.sum("_n")).alias("_mse"))
    best = errors.groupBy(*by).agg(F.min(F.struct("_mse", -F.col("_k"), "_k")).alias("_best"))
    chosen = parts.join(best, list(by)) if by else parts.crossJoin(F.broadcast(best))  # one row each

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                _, (mean, std, my, directions, length, xy) = shaped(tuple(r[c] for c in ("n", *names)))
                alpha = alphas[int(r["_k"])]
                w = directions @ (xy / (length + alpha)[:, None]) / std[:, None]
                out.append((*[r[c] for c in by], alpha, r["_mse"], w.ravel().tolist(), (my - mean @ w).tolist()))
            yield pd.DataFrame(out, columns=[*by, "alpha", "mse", "w", "b"])

    chosen = chosen.select(*by, "n", *names, "_best._mse", "_best._k")
    return chosen.mapInPandas(solve, ", ".join([*_kinds(rows, by), "alpha double, mse double, w array<double>, b array<double>"]))


def loo_alpha(rows: DataFrame, *by: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(by, alpha, mse): per group the alpha of least leave-one-out error."""
    return loo_fit(rows, *by, alphas=alphas).select(*by, "alpha", "mse")

