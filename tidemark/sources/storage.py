"""Tables, the folder that all machines share, and tables written there on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table for work that costs far more than to move its rows. A file is read by one
    task for each of its row groups, so small tables may keep only a few of all cores busy;
    their rows are dealt anew. Tables with work for all are left alone, without a shuffle:
    they aren't looked at if they have four splits for each core, and else by a job that
    reads no column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    filled = df.select(F.spark_partition_id().alias("split")).distinct().count()
    return df if filled >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a
    temporary folder in local mode, in which there is one machine, and else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = by_code.get() if by_code.isDefined() else None
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or in that of the innermost temporary()."""
    folders = _folders.get()
    return f"{folders[-1] if folders else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A folder for all tables that are written on the way inside, which goes at the end,
    also after an error. Results that read from them must be written by then."""
    folder = new_path(spark, name)
    token = _folders.set((*_folders.get(), folder))
    try:
        yield folder
    finally:
        _folders.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows starts from
    those files, also after executors were lost. They stay, unless in temporary()."""
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
