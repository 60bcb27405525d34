"""Rankings, histograms and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rows import with_sums


def top_parcels(parcels: DataFrame, n: int = 20) -> DataFrame:
    """The n parcels of highest r; of equals those of lower number."""
    return parcels.orderBy(F.desc_nulls_last("r"), "parcel").limit(n)


def histogram(rows: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """(bin, lo, n) of the bins of equal width that hold values; the last holds its end.
    Values that are all equal are in bin 0."""
    own = rows.where(F.col(value).isNotNull())
    ends = own.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins)), F.lit(0))
    d = own.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), at).cast("long"))  # one row
    lo = F.min("_lo") + F.col("bin") * (F.min("_hi") - F.min("_lo")) / bins
    return d.groupBy("bin").agg(lo.alias("lo"), F.count("*").alias("n"))


def upper_nonzero(rows: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """One row: the percentile of the absolute values that aren't 0, between the two values
    around it in proportion. Values are counted first, so that one that is very common is
    one row, and summed up by ranges of values; two are picked by place."""
    counts = rows.where(F.col(value) != 0).groupBy(F.abs(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    own = with_sums(counts, "_v", "_n", name="_before")
    at = own.agg((F.lit(share) * (F.sum("_n") - 1)).alias("_at"))
    # A value has all places from _before on, up to _before + _n - 1.
    near = own.crossJoin(F.broadcast(at)).where((F.col("_before") < F.col("_at") + 1) & (F.col("_before") + F.col("_n") - 1 > F.col("_at") - 1))  # one row
    rest = F.max("_at") - F.floor(F.max("_at"))
    return near.agg((F.min("_v") + rest * (F.max("_v") - F.min("_v"))).alias("limit"))


def axis_limit(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: a little more than the largest absolute value of two columns."""
    return rows.agg((F.max(F.greatest(F.abs(a), F.abs(b))) * 1.05).alias("limit"))


def side_by_side(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """r of two models per parcel, or other keys, as r_a and r_b."""
    keys = list(keys or ("parcel",))
    return a.select(*keys, F.col("r").alias("r_a")).join(b.select(*keys, F.col("r").alias("r_b")), keys)


def listed_order(column: str, values: list[str]) -> Column:
    """A key that sorts as a list does; values that aren't in it come last."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return F.when(at > 0, at).otherwise(len(values) + 1)


def result_table(results: DataFrame) -> DataFrame:
    """The roll-up of result files: subject, feature_key and four scores, in order."""
    return results.select("subject", "feature_key", "mean_r", "median_r", "max_r", "pct_positive").orderBy("subject", "feature_key")


def least_values(rows: DataFrame, value: str, name: str, *by: str, n: int = 10) -> DataFrame:
    """(by, name): the n least different values of each group, as an array. Equal rows are
    put together first; then each task hands on no more than n of a group."""
    order = Window.partitionBy(*by).orderBy(value)
    own = rows.where(F.col(value).isNotNull()).select(*by, value).distinct()
    own = own.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
    return own.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def subject_report(clips: DataFrame) -> DataFrame:
    """One row per subject of clips (subject, clip, n_aligned, r): counts, mean r, and the
    clips as an array of structs. A subject has as many clips as were shown, which is
    bounded by the study, not by the length of the recordings."""
    rows = F.array_sort(F.collect_list(F.struct("clip", "n_aligned", "r")))
    return clips.groupBy("subject").agg(F.count("*").alias("n_clips"), F.sum("n_aligned").alias("n_samples"), F.avg("r").alias("mean_r"), rows.alias("clips"))


def extent(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Least, largest and mean value of each group."""
    return rows.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("largest"), F.avg(value).alias("mean"))
