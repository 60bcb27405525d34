"""Splits into training and test parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rows import dealt, with_index, with_rank


def clip_split(clips: DataFrame, order: str = "clip", fraction: float = 0.8, least_train: int = 4, least_test: int = 1, group: tuple[str, ...] = ()) -> DataFrame:
    """``clips`` with rank (from 1), train (boolean): the first clips in order train, so many
    as the fraction rounded down, within the least numbers of both parts. Raises where a
    group has too few clips. A clip is one row here, whatever its length."""
    d = with_rank(clips, group, order) if group else with_index(clips, order, name="rank")
    counts = d.groupBy(*group).agg(F.count("*").alias("_n"))
    d = d.join(counts, list(group)) if group else d.crossJoin(F.broadcast(counts))  # one row
    d = d.withColumn("rank", F.col("rank") + 1)
    n_train = F.greatest(F.lit(least_train), F.least(F.floor(F.col("_n") * F.lit(fraction)), F.col("_n") - least_test))
    few = F.raise_error(F.concat(F.lit("too few clips to split: "), F.col("_n").cast("string"))).cast("boolean")
    train = F.when(F.col("_n") < least_train + least_test, few).otherwise(F.col("rank") <= n_train)
    return d.withColumn("train", train).drop("_n")


def folds(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """``rows`` with fold (from 0): contiguous runs in order, not shuffled."""
    return dealt(rows, k, *order, name="fold")


def of_part(rows: DataFrame, split: DataFrame, train: bool, *keys: str) -> DataFrame:
    """Rows of the clips of one part."""
    keys = list(keys or ("clip",))
    return rows.join(split.where(F.col("train") == train).select(*keys), keys, "left_semi")
