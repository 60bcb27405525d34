"""Joining features to responses, and the bookkeeping of what has no partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import written

LAG = 3
CELL = 2048  # rows of needles, and of texts, whose pairs are made together at least
HELD = 1 << 16  # rows of equal needles that a task holds, while their texts pass by


def lag_align(features: DataFrame, responses: DataFrame, keys: tuple[str, ...] = ("clip",), lag: int = LAG, least: int = 2) -> DataFrame:
    """Each feature row (…, tr) with the response row of equal keys at tr + lag; both sides'
    other columns stay. Groups of ``responses``' keys with fewer than ``least`` pairs go.

    The lag is part of an equality, so the join is hashed or merged on all keys.
    """
    later = responses.withColumn("tr", F.col("tr") - lag)
    pairs = features.join(later, [*keys, "tr"])
    by = [c for c in ("subject",) if c in pairs.columns and c not in keys] + list(keys)
    n = pairs.groupBy(*by).count().where(F.col("count") >= least)
    return pairs.join(n.drop("count"), by, "left_semi")


def same_length(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("clip",)) -> DataFrame:
    """Rows of both at equal (keys, tr) without a lag: of unequal lengths the shorter."""
    return left.join(right, [*keys, "tr"])


def matched_once(wanted: DataFrame, files: DataFrame, key: str = "clip") -> DataFrame:
    """``wanted`` with the file of their key where exactly one file has it."""
    others = [c for c in files.columns if c != key]
    single = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("_file")).where("_n = 1")
    return wanted.join(single.select(key, *[F.col("_file")[c].alias(c) for c in others]), key)


def _grams(text: Column, q: int) -> Column:
    """The different runs of q characters of a text, as an array."""
    places = F.sequence(F.lit(1), F.length(text) - q + 1)
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(places, lambda k: F.substr(text, k, F.lit(q)))))


def _keys(needles: DataFrame, hay: DataFrame, needle: str, text: str, q: int) -> tuple[DataFrame, list[int]]:
    """(_needle, _gram, _q, _m, _n), and the lengths of runs: each different needle with its run
    that fewest texts have, how often it is asked for and how many texts have that run.
    Needles whose runs aren't all in texts are left out."""
    asked = needles.groupBy(F.col(needle).alias("_needle")).agg(F.count("*").alias("_m"))
    n = F.length("_needle")
    asked = asked.withColumn("_q", F.greatest(F.least(n, F.lit(q)), *[F.when(n >= q * k, q * k) for k in (2, 4)]))
    lengths = sorted(r["_q"] for r in asked.select("_q").distinct().collect())  # q + 3 numbers at most
    counts = hay.select(F.explode(_runs(text, lengths)).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_n"))
    grams = F.expr("CASE WHEN _q = 0 THEN array('') ELSE array_distinct(transform(sequence(1, length(_needle) - _q + 1), k -> substr(_needle, k, _q))) END")
    rarest = asked.select("_needle", "_q", "_m", F.explode(grams).alias("_gram")).join(counts.hint("merge"), "_gram", "left")
    rarest = rarest.groupBy("_needle", "_q", "_m").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_key"))
    keys = rarest.where("_key.n > 0").select("_needle", F.col("_key.gram").alias("_gram"), "_q", "_m", F.col("_key.n").alias("_n"))
    return written(keys, "keys"), lengths


def _runs(text: str, lengths: list[int]) -> Column:
    runs = [F.array(F.lit("")) if n == 0 else F.coalesce(_grams(F.col(text), n), F.array().cast("array<string>")) for n in lengths]
    return F.concat(F.array().cast("array<string>"), *runs)


def _found(keys: DataFrame, hay: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """Rows of ``hay`` with the _needle, _m and _n of each key that they contain. Texts with
    their runs are far more than the files they are read from, which Spark goes by: without
    the hint it may broadcast them."""
    runs = hay.select("*", F.explode(_runs(text, [n for n in lengths if n])).alias("_gram"))
    found = runs.join(keys.hint("merge"), "_gram").where(F.contains(text, F.col("_needle"))).select(*hay.columns, "_needle", "_m", "_n")
    every = keys.where("_q = 0").first()  # the empty needle
    return found.unionByName(hay.select("*", F.lit("").alias("_needle"), F.lit(every._m).alias("_m"), F.lit(every._n).alias("_n"))) if every else found


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str, q: int = 3) -> DataFrame:
    """Each row of ``needles`` with each row of ``texts`` that contains it: the columns of both,
    which have different names. Nulls match nothing, an empty needle everything.

    A needle is looked up by one of its runs of q, 2 q or 4 q characters (the most that it
    has), the one that fewest texts have: an equality, so that the join is merged, and only
    what shares that run is compared. A needle of fewer characters is such a run itself, of its
    own length. Of equal needles one is looked up. What it stands for, rows of needles times
    rows of texts, is cut into cells, which are dealt to tasks: needles that recur, and that
    very many texts have, are no skewed key. Rows are copied for each cell that they belong
    to, so the number of cells goes by the cores and not by the pairs, and cells have about as
    many rows of needles as of texts: copies grow as the input does. Only beyond HELD rows of
    one needle in a cell are there more cells."""
    spark = needles.sparkSession
    # Any numbers do to deal rows by, but equal rows must differ in them.
    own = needles.where(F.col(needle).isNotNull()).withColumn("_at", F.floor(F.rand(1) * (1 << 31)))
    hay = texts.where(F.col(text).isNotNull()).withColumn("_at", F.floor(F.rand(2) * (1 << 31)))
    keys, lengths = _keys(own, hay.drop("_at"), needle, text, q)
    product = F.col("_m").cast("double") * F.col("_n")
    pairs = keys.agg(F.sum(product)).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    share = max(CELL * CELL, pairs / (16 * cores))  # pairs of a cell
    tasks = int(max(cores, min(4 * cores, pairs // (1 << 18)), 4 * (pairs // share)))
    cells = F.ceil(product / share)
    down = F.greatest(F.ceil(F.col("_m") / F.lit(HELD)), F.least(cells, F.round(F.sqrt(cells * F.col("_m") / F.col("_n"))).cast("long")), F.lit(1)).cast("int")
    across = F.ceil(cells / down).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = own.join(keys.hint("merge"), F.col(needle) == F.col("_needle")).repartition(4 * cores, "_at")
    asked = asked.select(*needles.columns, "_needle", (F.col("_at") % down).cast("int").alias("_down"), each(across).alias("_across"))
    found = _found(keys, hay, text, lengths).repartition(4 * cores, "_at")
    found = found.select(*texts.columns, "_needle", (F.col("_at") % across).cast("int").alias("_across"), each(down).alias("_down"))
    cell = ["_needle", "_down", "_across"]
    out = found.repartition(tasks, *cell).hint("merge").join(asked.repartition(tasks, *cell), cell)
    return out.select(*needles.columns, *texts.columns)


def contained_once(needles: DataFrame, texts: DataFrame, needle: str, text: str, q: int = 3) -> DataFrame:
    """The same, for needles that exactly one text contains. Of a needle that is a run itself
    it is known how many texts have it."""
    own, hay = needles.where(F.col(needle).isNotNull()), texts.where(F.col(text).isNotNull())
    keys, lengths = _keys(own, hay, needle, text, q)
    found = _found(keys.where((F.col("_n") == 1) | (F.length("_needle") > F.col("_q"))), hay, text, lengths)
    others = texts.columns
    single = found.groupBy("_needle").agg(F.count("*").alias("_count"), F.first(F.struct(*others)).alias("_text")).where("_count = 1")
    single = single.select("_needle", *[F.col("_text")[c].alias(c) for c in others])
    return own.join(single.hint("merge"), F.col(needle) == F.col("_needle")).select(*needles.columns, *others)


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key ``found`` doesn't have."""
    return wanted.join(found.select(key).distinct(), key, "left_anti")


def unmatched(files: DataFrame, used: DataFrame, key: str, condition: Column, use: Column | None = None) -> DataFrame:
    """Files that nothing used, of those that fulfil the condition. With ``use``, a file is
    used if that holds for one of its rows in ``used``."""
    own = used if use is None else used.groupBy(key).agg(F.bool_or(use).alias("_used")).where("_used")
    return missing(files.where(condition), own, key)


def shared_keys(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that every group has."""
    groups = rows.agg(F.count_distinct(group).alias("_all"))
    own = rows.groupBy(key).agg(F.count_distinct(group).alias("_own"))
    return own.join(F.broadcast(groups), F.col("_own") == F.col("_all")).select(key)  # one row
