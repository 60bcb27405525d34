"""A training corpus from raw documents, in stages that are written one after another.

Every stage takes rows with nulls in any column, repeated rows and ids, texts of any
length, further columns (which go) and tables without rows; what it then does is said
with it. The last gives ids of pieces instead of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import spread, table, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.pieces import sampled_pieces
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.queries import piece_model
from tidemark.llm.secrets import secret_scan
from tidemark.llm.simhash import simhash_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail. Null and empty texts fail; rows
    are judged by themselves, whatever their ids."""
    d = quality_rules(docs).where("kept")
    return d.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, the one of least id, or one without id if
    none has any. Rows are told apart by a key of their own, that is written once: rows that
    repeat an id, or have none, are documents like others. Null, empty and blank texts are
    copies of each other."""
    rows = written(docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")), "keyed")
    near = simhash_components(rows, doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_row")
    first = rows.select("_row", "doc_id", "_hash").join(near, "_row").groupBy("component_id").agg(F.min(order).alias("_first"))
    return rows.join(first.select("_first._row"), "_row", "left_semi").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test items, or too few words of them. Null and empty texts hold
    none and stay. Items without id count like others; without items all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS), unnamed=True).where("not contaminated").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced. A null text stays null."""
    d = secret_scan(docs, keep=tuple(c for c in COLUMNS if c not in ("text", "n_chars")))
    return d.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars")).select(*COLUMNS)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document. Null and empty texts are the piece of the space that
    is thought before a text; draws of rows without id are those of id 0."""
    return sampled_pieces(docs, piece_model(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", without_near_copies),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("pieces", as_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. An empty table gives an empty one."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# No SQL: fingerprints and sampled segmentations have no SQL form.
ORACLE_SQL = None
