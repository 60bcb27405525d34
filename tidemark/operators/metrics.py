"""Scores of predictions, and standard scores. Undefined values are null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import fisher, pearson
from tidemark.operators.tiles import grouped


def r2(y: Column, p: Column) -> Column:
    """1 - residual / total sum of squares of a group, over the rows that have both. Where y
    doesn't vary: 1 if there is no residual, else 0."""
    own = F.when(p.isNotNull(), y)
    rest, total = F.sum((y - p) * (y - p)), F.var_pop(own) * F.count(own)
    return F.when(total > 0, 1 - F.try_divide(rest, total)).when(total.isNull(), None).otherwise(F.when(rest == 0, 1.0).otherwise(0.0))


def scores(pairs: DataFrame, *by: str, y: str = "y", p: str = "p", zero_fill: bool = False) -> DataFrame:
    """Per group: r, r2 and n of responses and predictions, in one pass. ``zero_fill`` puts 0
    for an undefined r."""
    r = pearson(F.col(p), F.col(y))
    return pairs.groupBy(*by).agg((F.coalesce(r, F.lit(0.0)) if zero_fill else r).alias("r"), r2(F.col(y), F.col(p)).alias("r2"), F.count("*").alias("n"))


def correlations(pairs: DataFrame, *by: str, x: str = "x", y: str = "y", zero_fill: bool = False) -> DataFrame:
    """Per group: r and n. Sums are combined before the shuffle."""
    r = pearson(F.col(x), F.col(y))
    return pairs.groupBy(*by).agg((F.coalesce(r, F.lit(0.0)) if zero_fill else r).alias("r"), F.count("*").alias("n"))


def over_parcels(parcel_scores: DataFrame, *by: str) -> DataFrame:
    """Mean and median of r and r2 over the parcels where they are defined."""
    named = [f(c).alias(f"{n}_{c}") for c in ("r", "r2") if c in parcel_scores.columns for n, f in (("mean", F.avg), ("median", F.median))]
    return parcel_scores.groupBy(*by).agg(*named, F.count("*").alias("n_parcels"))


def summary(parcel_scores: DataFrame, *by: str) -> DataFrame:
    """Mean, median and maximum of r, and the percentage of parcels with a positive one."""
    positive = F.avg((F.col("r") > 0).cast("double")) * 100
    return parcel_scores.groupBy(*by).agg(F.avg("r").alias("mean_r"), F.median("r").alias("median_r"), F.max("r").alias("max_r"), positive.alias("pct_positive"))


def subject_correlations(responses: DataFrame, by: tuple[str, ...] = ("clip", "parcel")) -> DataFrame:
    """(a, b, by, r, n): r of each unordered pair of subjects over the steps that both have.

    The responses of a step, one a subject, are put side by side; each task adds up its
    steps' products of all pairs as matrices, and what is shuffled is one row for each
    pair, group and task. Subjects, of whom a study has a bounded number, are listed and
    their means taken first: products are of what is left, so that large means cost no
    digits. A response that is null or NaN isn't there; of several of a subject at one
    step the mean is taken."""
    own = responses.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")) & F.col("subject").isNotNull())
    means = {r["subject"]: r["m"] for r in own.groupBy("subject").agg(F.avg("y").alias("m")).collect()}  # one row a subject
    subjects = sorted(means)
    if len(subjects) < 2:
        subjects = (subjects + [None, None])[:2]
    kind, number = responses.schema["subject"].dataType, {s: k for k, s in enumerate(subjects)}
    steps = own.groupBy(*by, "tr").agg(F.collect_list(F.struct("subject", F.col("y").cast("double").alias("y"))).alias("_all"))
    first, second = np.triu_indices(len(subjects), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            who = np.array([number[s] for s in flat.field("subject").to_pylist()], np.int64)
            left = flat.field("y").to_numpy(zero_copy_only=False) - np.array([means[subjects[k]] for k in who.tolist()])
            there, y = np.zeros((b.num_rows, len(subjects))), np.zeros((b.num_rows, len(subjects)))
            np.add.at(there, (row, who), 1.0)
            np.add.at(y, (row, who), left)
            y /= np.maximum(there, 1.0)
            there = np.minimum(there, 1.0)
            for key, at in grouped(b, by):
                m, v = there[at], y[at]
                # Of each pair: steps that both have, and sums, squares and products over these.
                parts = np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v])[:, first, second]
                sums[key] = sums[key] + parts if key in sums else parts
        for key, parts in sums.items():
            some = np.flatnonzero(parts[0])
            pairs = [[subjects[k] for k in at[some].tolist()] for at in (first, second)]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(pairs[0], types["a"]), "b": pa.array(pairs[1], types["b"]), **{c: pa.array([v] * len(some), types[c]) for c, v in zip(by, key, strict=True)}}
                | {c: pa.array(p[some]) for c, p in zip(names, parts, strict=True)}
            )

    from pyspark.sql.pandas.types import to_arrow_type

    names = ("n", "sa", "sb", "saa", "sbb", "sab")
    fields = [T.StructField("a", kind), T.StructField("b", kind), *[responses.schema[c] for c in by], *[T.StructField(c, T.DoubleType()) for c in names]]
    types = {f.name: to_arrow_type(f.dataType) for f in fields}
    total = steps.select(*by, "_all").mapInArrow(run, T.StructType(fields)).groupBy("a", "b", *by).agg(*[F.sum(c).alias(c) for c in names])
    square = lambda s, ss: ss - F.col(s) * F.col(s) / F.col("n")
    va, vb = square("sa", F.col("saa")), square("sb", F.col("sbb"))
    # What rounding leaves of a side that doesn't vary isn't variation.
    varies = (va > F.col("saa") * 1e-13) & (vb > F.col("sbb") * 1e-13)
    r = F.when(varies, F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), F.sqrt(va) * F.sqrt(vb)))
    return total.select("a", "b", *by, r.alias("r"), F.col("n").cast("long").alias("n"))


def inter_subject(responses: DataFrame, by: tuple[str, ...] = ("clip", "parcel")) -> DataFrame:
    """Mean correlation of the pairs of subjects per clip and parcel, by Fisher's z."""
    pairs = subject_correlations(responses, by).where("r is not null")
    return pairs.groupBy(*by).agg(F.tanh(F.avg(fisher(F.col("r")))).alias("isc"), F.count("*").alias("n_pairs"))


def noise_ceiling(responses: DataFrame) -> DataFrame:
    """One row: the mean over parcels of the means over clips, and the number of parcels."""
    parcels = inter_subject(responses).groupBy("parcel").agg(F.avg("isc").alias("isc"))
    return parcels.agg(F.avg("isc").alias("noise_ceiling"), F.count("*").alias("n"))


def standardised(train: DataFrame, rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``rows`` with z: value less the training mean, by the training population deviation;
    a deviation of 0 counts as 1."""
    fit = train.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    by_one = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return rows.join(fit, list(by)).withColumn("z", (F.col(value) - F.col("_mean")) / by_one).drop("_mean", "_std")
