"""A corpus pipeline over ``documents``: language ID, line dedup, SimHash
near-dedup, benchmark decontamination, best-fit packing.

Each stage works on all that its predecessor kept; all but the last return the
columns of ``documents``. A stage takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and rereads for the next.

Rows that agree in ``doc_id`` and ``text`` are one document to every stage, and
are kept or dropped together; rows that share a ``doc_id`` only are told apart
by their text, and each is decided on its own. A null ``doc_id`` is an id like
any other, except that it comes after the others as the smallest of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm.common import table, written
from tokensieve.llm.decontaminate import leaks
from tokensieve.llm.langid import identify
from tokensieve.llm.line_dedup import dedup_passages
from tokensieve.llm.packing import pack_documents
from tokensieve.llm.simhash_dedup import near_duplicates


def _own() -> Column:
    """What tells documents apart: the id and a hash of the text. Where ids are
    compared, a null one comes last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))


def _where(docs: DataFrame, own: DataFrame, how: str) -> DataFrame:
    """``docs`` joined on (id, hash of the text) with the identities ``own``."""
    sought = own.select(F.col("own.id").alias("_ts_id"), F.col("own.h").alias("_ts_h")).distinct()
    return docs.join(sought, F.col("doc_id").eqNullSafe(F.col("_ts_id")) & (F.xxhash64("text") == F.col("_ts_h")), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language (text with a letter), those too
    whose language is not told because no row is labelled. Which language was
    told decides nothing."""
    named = identify(docs.withColumn("own", _own()), carry=("own",), unlearned="unknown").where("lang_pred = 'und'").select("own")
    return _where(docs, named, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of two lines or more out of the texts."""
    clean = dedup_passages(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*(f"`{c}`" for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group, of two texts under that id one."""
    groups = near_duplicates(docs.withColumn("doc_id", _own()), words=4, max_distance=4)
    return _where(docs, groups.where("doc_id = component_id").select(F.col("doc_id").alias("own")), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = leaks(docs.withColumn("doc_id", _own()), table(spark, sf_dir, "benchmark"))
    return _where(docs, found.select(F.col("doc_id").alias("own")), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents kept, and their places in the sequences."""
    return pack_documents(docs, capacity=4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the tokenizer nor the language model; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
