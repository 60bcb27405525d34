"""Values of parcels at the places of an atlas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_voxels(voxels: DataFrame, parcels: DataFrame, label: str = "label", value: str = "r") -> DataFrame:
    """Voxels with the value of the parcel of their label; 0 for the background and for
    parcels without a value."""
    p = parcels.select(F.col("parcel").alias(label), F.col(value).alias("_v"))
    return voxels.join(p, label, "left").withColumn(value, F.coalesce("_v", F.lit(0.0))).drop("_v")


def at_vertices(vertices: DataFrame, parcels: DataFrame, half: int = 500) -> DataFrame:
    """Vertices (hemi, vertex, label) with r of the parcel that their rounded label names:
    up to ``half`` on the left, above on the right, others 0."""
    d = vertices.withColumn("parcel", F.rint("label").cast("long"))
    left = (F.col("hemi") == "L") & F.col("parcel").between(1, half)
    right = (F.col("hemi") == "R") & F.col("parcel").between(half + 1, 2 * half)
    d = d.withColumn("parcel", F.when(left | right, F.col("parcel")))
    return d.join(parcels.select("parcel", F.col("r").alias("_v")), "parcel", "left").withColumn("r", F.coalesce("_v", F.lit(0.0))).drop("_v")


def over_subjects(parcels: DataFrame) -> DataFrame:
    """Mean r of each parcel over subjects."""
    return parcels.groupBy("parcel").agg(F.avg("r").alias("r"))
