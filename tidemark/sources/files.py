"""Files of recordings and results: listing, reading, writing, and what is left to do."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import natural_key

RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("model", "feature_key", "subject")]
    + [T.StructField(n, T.LongType()) for n in ("n_timepoints", "n_features", "n_parcels", "n_folds")]
    + [T.StructField(n, T.DoubleType()) for n in ("mean_r", "median_r", "max_r", "pct_positive")]
)

# Names and defaults of the settings of a run.
SETTINGS = {
    "tr": 1.49, "chunk_length": 8.0, "seconds_before_chunk": 6.0, "sample_fraction": 0.1, "minimum_samples": 8, "feature_key": "enc-last-ln",
    "lag_trs": 3, "train_fraction": 0.8, "minimum_train_clips": 4, "minimum_test_clips": 1, "ridge_alphas": [0.1, 1.0, 10.0, 100.0, 1000.0],
    "subjects": [], "input_root": "", "output_root": "", "force": False,
}


# Settings that features depend on.
MADE_BY = ("tr", "chunk_length", "seconds_before_chunk", "sample_fraction", "minimum_samples", "feature_key")


def digest(found: dict, names: tuple[str, ...] = MADE_BY) -> str:
    """A short name for the settings that something is made by: equal ones give equal names."""
    return hashlib.sha256(json.dumps({n: found[n] for n in sorted(names)}, sort_keys=True).encode()).hexdigest()[:16]


def recordings(spark: SparkSession, root: str, pattern: str = "*.{mkv,mp4}") -> DataFrame:
    """(path, name, length, key): files below ``root`` by name; sort by key for the natural
    order. Contents aren't read. Raises if there are none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if not files.limit(1).count():
        raise FileNotFoundError(f"no file {pattern} below {root}")
    return files.withColumn("key", natural_key(F.col("name")))


def allowed(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files whose name is listed in ``names`` (name). Raises if a listed one isn't there."""
    absent = [r.name for r in names.distinct().join(files.select("name").distinct(), "name", "left_anti").orderBy("name").limit(10).collect()]
    if absent:
        raise FileNotFoundError(f"listed but not found: {', '.join(map(str, absent))}")
    return files.join(names.distinct(), "name", "left_semi")


def settings(spark: SparkSession, path: str | None = None, **own) -> dict:
    """The settings of a run: those that a JSON file and then arguments give, else the
    defaults. Names that are unknown, and values of another kind, raise."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if not isinstance(given, dict):
        raise ValueError("settings are names with values")
    found = dict(SETTINGS)
    for name, value in {**given, **own}.items():
        if name not in SETTINGS:
            raise ValueError(f"unknown setting {name}; known are {', '.join(SETTINGS)}")
        kind = float if isinstance(SETTINGS[name], float) else type(SETTINGS[name])
        if isinstance(value, bool) != (kind is bool) or not isinstance(value, (int, float) if kind is float else kind):
            raise ValueError(f"{name} is {value!r}, not of kind {kind.__name__}")
        found[name] = kind(value)
    return found


def shuffled(files: DataFrame, path: str = "path") -> DataFrame:
    """Files in an order that looks random but depends on their paths only."""
    return files.orderBy(F.xxhash64(path), path)


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per result file (JSON); files that don't parse are left out, missing fields
    are null."""
    schema = T.StructType([*RESULT.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A summary as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_features(features: DataFrame, path: str) -> None:
    """Features by feature_key: readers of one key scan its folder only. Keys that are
    written again are replaced, others stay."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_key").parquet(path)


def write_recording(features: DataFrame, manifest: DataFrame, path: str, made_by: str = "") -> None:
    """Features (clip, feature_key, …), the manifest (clip, feature_key and what is known
    of each recording) and, last of all, a marker for each that is done: what has no
    marker is made again, whatever else is there. ``made_by`` is the digest() of the
    settings; it is in the manifest and in the marker. A recording that is written again,
    under these or other settings, is replaced: its marker goes first."""
    keys = ("clip", "feature_key")
    own = manifest.select(*keys).distinct()
    mark = lambda status: own.withColumns({"status": F.lit(status), "made_by": F.lit(made_by)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/done")
    if not finished(features.sparkSession, path).join(own, list(keys), "left_semi").isEmpty():
        mark("started")
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/features")
    manifest.withColumn("made_by", F.lit(made_by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(f"{path}/manifest")
    mark("ok")


def finished(spark: SparkSession, path: str, made_by: str | None = None) -> DataFrame:
    """(clip, feature_key) of the recordings that have a marker, of those that were made by
    these settings if that is given; none if nothing is there."""
    try:
        done = spark.read.parquet(f"{path}/done").where("status = 'ok'")
    except AnalysisException:
        return spark.createDataFrame([], "clip string, feature_key string")
    done = done if made_by is None else done.where(F.col("made_by") == made_by)
    return done.select(F.col("clip").cast("string").alias("clip"), F.col("feature_key").cast("string").alias("feature_key"))


def write_analysis(predictions: DataFrame, reports: DataFrame, path: str) -> None:
    """Predictions and reports by subject: subjects that are written again are replaced,
    others stay. Then a summary of all reports, in one file."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").parquet(f"{path}/predictions")
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").json(f"{path}/reports")
    every = reports.sparkSession.read.schema(reports.schema).json(f"{path}/reports")
    every.orderBy("subject").coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def unfinished(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What of ``work`` has no finished counterpart: how an interrupted run goes on."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def vector(column: str, kind: str = "double") -> Column:
    """An array of features in the given precision."""
    kinds = {"float16": "float", "bfloat16": "float", "float32": "float", "float": "float", "double": "double", "float64": "double"}
    if kind not in kinds:
        raise ValueError(f"unknown precision {kind}")
    return F.col(column).cast(f"array<{kinds[kind]}>")
