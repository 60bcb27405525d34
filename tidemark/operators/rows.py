"""Places of rows in an order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import written


def with_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """``df`` with each row's place from 0 in ``order``, which should have no ties. Rows are
    dealt by ranges and sorted there; the counts of the ranges, one row each, are summed."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = written(d.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "indexed")
    parts = d.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per range: its size is that of the list of partitions.
    starts = parts.select("_p", "_least", before.alias("_start"))
    return d.join(F.broadcast(starts), "_p").withColumn(name, F.col("_i") - F.col("_least") + F.col("_start")).drop("_p", "_i", "_least", "_start")


def with_sums(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each, in the order of a column
    without ties: ranges are sorted and summed apart, and their sums, one row each, then."""
    d = written(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_p").agg(F.sum(value).alias("_s")).select("_p", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_start"))  # one row per range
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_i", inside).join(F.broadcast(starts), "_p").withColumn(name, F.col("_i") + F.col("_start")).drop("_p", "_i", "_start")


def with_rank(df: DataFrame, group: tuple[str, ...], *order: str, name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 0 among the rows of its group. Groups may be of any
    length: rows are dealt by ranges of (group, order), and what is summed are the counts
    of each group in each range."""
    d = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    d = written(d.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranked")
    parts = d.groupBy("_p", *group).agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_least", before.alias("_start"))
    return _joined(d, starts, {"_p": "_q"} | {g: f"_g{k}" for k, g in enumerate(group)}).withColumn(name, F.col("_i") - F.col("_least") + F.col("_start")).drop("_p", "_i", "_least", "_start")


def _joined(d: DataFrame, starts: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``d`` with the row of ``starts`` of equal keys, of which null is one as well."""
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()]
    return d.join(starts, same).drop(*keys.values())


def with_rank_by_id(df: DataFrame, group: tuple[str, ...], key: str, name: str = "rank", block: int = 1 << 16) -> DataFrame:
    """The same where rows are in the order of an integer ``key`` that doesn't repeat much:
    groups of any length are cut into blocks of so many ids, ranked there, and the counts
    of the blocks are summed. Nothing is written on the way. A null key comes first."""
    d = df.withColumn("_b", F.floor(F.col(key) / F.lit(block)))
    counts = d.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_b").alias("_c"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key)) - 1
    d = _joined(d.withColumn("_i", inside), starts, {"_b": "_c"} | {g: f"_g{k}" for k, g in enumerate(group)})
    return d.withColumn(name, F.col("_i") + F.col("_start")).drop("_b", "_i", "_start")


def contiguous(index: Column, n: Column, parts: int) -> Column:
    """Which of ``parts`` runs of rows holds a place; the first n % parts runs have one row
    more."""
    small, more = F.floor(n / parts), n % parts
    ahead = more * (small + 1)
    return F.when(index < ahead, F.floor(index / (small + 1))).otherwise(more + F.floor(F.try_divide(index - ahead, small))).cast("long")


def dealt(df: DataFrame, parts: int, *order: str, name: str = "part") -> DataFrame:
    """``df`` with the number, from 0, of the contiguous run of rows that it is in."""
    total = df.agg(F.count("*").alias("_total"))
    d = with_index(df, *order, name="_index").crossJoin(F.broadcast(total))  # one row
    return d.withColumn(name, contiguous(F.col("_index"), F.col("_total"), parts)).drop("_index", "_total")
