"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_format, line_dedup, phrases
from .common import table
from .decontaminate import leaks
from .embed_dedup import near_vectors
from .html_extract import extract
from .langid import identify
from .packing import pack_documents
from .simhash_dedup import near_duplicates
from .simple8b import token_files
from .suffix_dedup import remove_repeats
from .toxicity import toxicity


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_control(table(spark, sf_dir, "conversations")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines", "removed_chunks")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return remove_repeats(table(spark, sf_dir, "documents"), length=200).select(
        "doc_id", "n_bytes", spans.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, max_distance=4)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), end_id=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), support=100, top=2000)


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_html_extraction, op3_embedding_near_dedup, op4_best_fit_packing, op5_line_dedup,
    op6_suffix_array_dedup, op7_simhash_near_dedup, op8_token_files, op9_language_id, op10_decontamination,
    op11_toxicity, op12_centroid_clustering, op13_phrase_mining)}

SQL = {
    "op1_chat_formatting": chat_format.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op12_centroid_clustering": centroids.SQL,
    "op13_phrase_mining": phrases.SQL,
}
