"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor shares, as the session names it.

    A local session may have none; it gets a temporary one. Anywhere else a
    missing setting is an error, because executors could not read each
    other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tokensieve-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tokensieve/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def spread(rows: int, per_task: int, least: int = 1) -> int:
    """How many salt buckets keep about ``per_task`` rows in each."""
    return max(least, -(-rows // per_task))
