"""Overlapping windows of recordings, samples of them, and their frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import whole

TR, LENGTH, LEAD = 1.49, 8.0, 6.0  # seconds: step, window, and how much of it comes before


def chunk_windows(clips: DataFrame, duration: str, tr: float = TR, length: float = LENGTH, lead: float = LEAD, exact_steps: bool = False) -> DataFrame:
    """One row per step of each recording, with the window that ends after the step:
    tr_index, tr_start, tr_end (of the step), chunk_start, chunk_end, and rel_start,
    rel_end of the step within it.

    Steps are counted as ceil(duration / tr). ``exact_steps`` adds the step up instead,
    as a loop would, which gives one more or less at some exact multiples of the step.
    Recordings without a positive duration have no rows.
    """
    if not (0 <= lead < length and lead + tr <= length):
        raise ValueError("the step and what comes before it must fit in the window")
    n = F.ceil(F.col(duration) / tr)
    if exact_steps:
        starts = F.sequence(F.lit(0), F.ceil(F.col(duration) / tr + 2).cast("int"))
        state = F.struct(F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("n"))
        step = lambda s, _: F.struct((s["t"] + tr).alias("t"), (s["n"] + (s["t"] < F.col(duration)).cast("long")).alias("n"))
        n = F.aggregate(starts, state, step)["n"]
    d = clips.where(F.col(duration) > 0).withColumn("tr_index", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    start = F.col("tr_index") * F.lit(tr)
    d = d.withColumn("tr_start", start).withColumn("tr_end", start + tr)
    d = d.withColumn("chunk_start", F.greatest(F.lit(0.0), start - lead))
    d = d.withColumn("chunk_end", F.least(F.col("chunk_start") + length, F.col(duration).cast("double")))
    d = d.withColumn("rel_start", start - F.col("chunk_start"))
    return d.withColumn("rel_end", F.least(F.col("rel_start") + tr, F.col("chunk_end") - F.col("chunk_start")))


def sample_size(n: Column, fraction: float, least: int) -> Column:
    """How many of n steps are sampled: the fraction, but ``least`` where there are as many."""
    return F.least(n, F.greatest(F.lit(least).cast("long"), whole(n * F.lit(fraction))))


def uniform_sample(sizes: DataFrame, n: str, fraction: float = 0.1, least: int = 8) -> DataFrame:
    """One row per sampled step of each (…, n): sample_no and tr_index, evenly spread over
    0 … n-1 with both ends; all steps where fewer than ``least`` or the whole is asked for."""
    count = F.col(n).cast("long")
    k = sample_size(count, fraction, least)
    d = sizes.withColumn("_k", k).where("_k > 0").withColumn("sample_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    even = whole(F.col("sample_no") * F.try_divide((count - 1).cast("double"), (F.col("_k") - 1).cast("double")))
    return d.withColumn("tr_index", F.when(F.col("_k") == 1, F.lit(0).cast("long")).otherwise(even)).drop("_k")


def frame_ranges(windows: DataFrame, fps: str, total: str) -> DataFrame:
    """Windows with first_frame and end_frame (exclusive); those without a frame go."""
    first = whole(F.col("chunk_start") * F.col(fps))
    d = windows.withColumn("first_frame", first)
    d = d.withColumn("end_frame", F.least(F.col("first_frame") + whole((F.col("chunk_end") - F.col("chunk_start")) * F.col(fps)), F.col(total).cast("long")))
    return d.where("end_frame > first_frame")


def frame_indices(n: Column, most: int) -> Column:
    """Up to ``most`` of n frames as an array, evenly spread with both ends; all frames
    where there aren't more."""
    n = n.cast("long")
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    if most == 1:
        few = F.array(F.lit(0).cast("long"))
    else:
        few = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: whole(i * ((n - 1) / F.lit(most - 1))))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= most, every).otherwise(few)
