"""The tables of an encoding study, taken from the given ones.

``label`` of an embedding stands for its clip, its rank there for the step, its numbers
for features and parcels. The type of an event stands for the subject, six hours for a
step, ten days for a clip, and its value for the response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rows import with_rank_by_id
from tidemark.sources.storage import table


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """(clip, tr, vec_id, embedding). Clips may be of any length."""
    d = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("clip"), "vec_id", "embedding")
    return with_rank_by_id(d, ("clip",), "vec_id", name="tr").select("clip", "tr", "vec_id", "embedding")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, clip, tr, parcel, y): means of values per step."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)
    step = lambda n: F.floor(seconds / n).cast("long")
    d = table(spark, folder, "events").select(F.col("event_type").alias("subject"), step(864_000.0).alias("clip"), step(21_600.0).alias("tr"), (F.col("user_id") % 5).alias("parcel"), "value")
    return d.groupBy("subject", "clip", "tr", "parcel").agg(F.avg("value").alias("y"))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, seconds): documents as recordings of a tenth of a second a character."""
    return table(spark, folder, "documents").select("doc_id", (F.col("n_chars") / F.lit(10.0)).alias("seconds"))


def design(spark: SparkSession, folder: str, features: int = 48) -> DataFrame:
    """(clip, tr, vec_id, x, y): the first numbers of an embedding as features, the others,
    at the same step, as responses."""
    d = clips(spark, folder).withColumn("v", F.col("embedding").cast("array<double>"))
    return d.select("clip", "tr", "vec_id", F.slice("v", 1, features).alias("x"), F.slice("v", F.lit(features + 1), F.size("v") - features).alias("y"))
