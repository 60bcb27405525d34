"""A bounded, documented sample of labelled documents for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, utf8


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)).cast("int")


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of all labels that may be learnt from; conflicting or null ones are
    left out."""
    own = labels.where(f"doc_id is not null and {label} in (0, 1)").where(fold("doc_id", folds) != held_out)
    return own.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_z")).where("y = _z").select("doc_id", "y")


def class_counts(train: DataFrame) -> tuple[int, int]:
    n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    return n.get(0, 0), n.get(1, 0)


def sampled(train: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, those of least hash: a set that doesn't
    depend on order or partitions."""
    parts = [train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1])


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sampled documents; of repeated ids the least text. The
    sample is of bounded size and is broadcast: texts outside it aren't shuffled."""
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "y")


def unlike(sample: DataFrame, hashes: int = 3) -> DataFrame:
    """The rows of a bounded sample (doc_id, text, y) less near copies, which would count
    as evidence many times: of rows that share a least hash of three words, under any of
    ``hashes`` hash functions, the one of least id stays."""

    def least(text: str, seed: int) -> int:
        w = utf8(text).split()
        return min(xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed) for i in range(max(1, len(w) - 2))) >> 1

    names = [f"h{k}" for k in range(hashes)]

    def run(batches):
        for ids, texts, ys in chunks(batches, "doc_id", "text", "y", rows=64):
            found = [pa.array([least(t, k) for t in texts], pa.int64()) for k in range(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(ys, pa.int32()), *found], names=["doc_id", "text", "y", *names])

    d = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
    d = d.mapInArrow(run, "doc_id long, text string, y int, " + ", ".join(f"{n} long" for n in names))
    for n in names:
        d = d.withColumn("_first", F.min("doc_id").over(Window.partitionBy(n))).where("doc_id = _first").drop("_first")
    return d.select("doc_id", "text", "y")
