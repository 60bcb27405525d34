"""The registered queries of this subpackage, and SQL for those that SQL can express.

Each query applies its operator, with the parameters of production, to the whole of its
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.alignment import counted_links, linked_by, token_groups
from tidemark.llm.centroids import centroid_clusters
from tidemark.llm.chat import chat_format
from tidemark.llm.common import spread, table, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.html_text import extract_text
from tidemark.llm.neighbours import quality_scores
from tidemark.llm.pieces import sampled_pieces
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.secrets import secret_scan
from tidemark.llm.simhash import simhash_components
from tidemark.llm.token_files import read_token_files, token_folder, write_token_files
from tidemark.llm.top_products import top_products
from tidemark.llm.toxicity import toxicity_scores


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, with work for all cores."""
    return spread(table(spark, sf_dir, name))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces(texts(spark, sf_dir), piece_model(), with_ids=False)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(texts(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost", 6).alias("lost")
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(texts(spark, sf_dir), with_text=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    files = written(write_token_files(table(spark, sf_dir, "documents"), folder, byte_bpe()), "token-files")
    return read_token_files(files, folder)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(texts(spark, sf_dir))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(texts(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), unnamed=True).drop("hit_spans")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spread(table(spark, sf_dir, "embeddings")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = token_groups(texts(spark, sf_dir), byte_bpe(), piece_model())
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = written(groups.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "alignments")
    return counted_links(rows, linked_by(byte_bpe(), piece_model()))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spread(table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sampled_pieces,
        op2_chat_format,
        op3_quality_rules,
        op4_secret_scan,
        op5_toxicity,
        op6_token_files,
        op7_quality_classifier,
        op8_simhash,
        op9_main_text,
        op10_decontaminate,
        op11_centroids,
        op12_token_alignment,
        op13_top_products,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": sql.QUALITY_RULES, "op10_decontaminate": sql.DECONTAMINATE, "op11_centroids": sql.CENTROIDS, "op13_top_products": sql.TOP_PRODUCTS}
