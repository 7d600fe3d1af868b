"""Result sinks (K1-K5): fixed-header projection and CSV, one output per
configuration, summary text, payload files with a manifest.

Writes are ordinary DataFrame writes (one job, partitioned by
configuration), never a driver loop over results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_filename

# The reference's 22-column results header, in order, and
# the 23rd column added by the open-answer flavour.
RESULT_COLUMNS = (
    "test_number", "total_tests", "sample_image_path", "timestamp", "embed_time", "api_call_time",
    "total_time", "api_success", "generated_text", "predicted_answer", "is_correct", "error_message",
    "full_response", "model_path", "original_token", "pruned_token", "api_url", "method",
    "preprocess_time", "encode_time", "project_time", "prune_time",
)
GUIDED_COLUMN = "guided_choices_used"
#: Texts keep their outer spaces, quotes and line feeds; a null is told from an empty text.
CSV_FORM = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# K1
def results_projection(df: DataFrame, guided: bool = False, extra=()) -> DataFrame:
    """Fixed header; a missing field becomes '', extra fields are dropped
    (``extra`` names columns kept after the header, e.g. partition keys)."""
    cols = RESULT_COLUMNS + ((GUIDED_COLUMN,) if guided else ()) + tuple(extra)
    return df.select(*[(F.col(c) if c in df.columns else F.lit("")).alias(c) for c in cols])


def write_results_csv(df: DataFrame, path: str, guided: bool = False, partition_by=None) -> bool:
    """CSV with header; no output at all when there are no rows."""
    proj = results_projection(df, guided, extra=tuple(partition_by or ()))
    if df.isEmpty():
        return False
    w = proj.write.mode("overwrite").options(**CSV_FORM)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return True


def read_results_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_results_csv`` wrote; partition columns come last in ``schema``."""
    return spark.read.schema(schema).options(**CSV_FORM, multiLine=True).csv(path)


# K2
def write_per_config(df: DataFrame, path: str, keys=("keep_ratio", "recovery_ratio"), guided: bool = False) -> bool:
    """One output folder per configuration in a single job."""
    return write_results_csv(df, path, guided, keys)


# K4
def summary_text(summary: DataFrame) -> Column:
    """Human-readable block per configuration (same lines as the reference)."""
    pct = lambda c: F.format_string("%.2f%%", F.round(F.col(c) * 100, 2))
    f2 = lambda c: F.format_string("%.2f", F.round(F.col(c), 2))
    f1 = lambda c: F.format_string("%.1f", F.round(F.col(c), 1))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("keep_ratio="), F.col("keep_ratio").cast("string"), F.lit(", recovery_ratio="),
                 F.col("recovery_ratio").cast("string")),
        F.concat(F.lit("Samples: "), F.col("n").cast("string")),
        F.concat(F.lit("Successful: "), F.col("n_success").cast("string")),
        F.concat(F.lit("Accuracy: "), pct("accuracy"), F.lit(" ("), F.col("n_correct").cast("string"),
                 F.lit("/"), F.col("n_success").cast("string"), F.lit(")")),
        F.concat(F.lit("Avg Embed Time: "), f2("avg_embed_time"), F.lit("s")),
        F.concat(F.lit("Avg API Time: "), f2("avg_api_time"), F.lit("s")),
        F.concat(F.lit("Avg Pruned Tokens: "), f1("avg_pruned_tokens")),
        F.concat(F.lit("Token Reduction: "), f1("token_reduction_pct"), F.lit("%")),
    )


def write_summary_text(summary: DataFrame, path: str) -> None:
    summary.select(summary_text(summary).alias("value")).write.mode("overwrite").text(path)


# K5
def payload_manifest(df: DataFrame, name_col: str, payload_col: str, order_col: str) -> DataFrame:
    """One row per input row: final file name and status (ok / failed)."""
    name = safe_filename(F.col(name_col), F.col(payload_col))
    ok = F.col(payload_col).isNotNull() & F.col(name_col).isNotNull()
    return df.select(
        F.col(order_col).alias("row_id"),
        F.when(ok, name).alias("file_name"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.col(payload_col).alias("payload"),
    )


def final_files(manifest: DataFrame) -> DataFrame:
    """Later rows overwrite earlier ones with the same name: last wins. The
    row is chosen without its payload, which is then joined by ``row_id``."""
    ok = manifest.where(F.col("status") == "ok")
    last = ok.groupBy("file_name").agg(F.max("row_id").alias("row_id"), F.count(F.lit(1)).alias("n_writes"))
    return last.join(ok.select("row_id", "payload"), "row_id").select("file_name", "row_id", "payload", "n_writes")


def write_payload_files(files: DataFrame, out_dir: str) -> None:
    """Write each final payload to ``out_dir/<file_name>``, a folder (path or
    URI) that all executors share. A file appears under its name when whole,
    so a repeated task leaves no half of one."""
    target = _uri(out_dir)
    _store(target)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(target)
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(payload)
                store.move(part, f"{folder}/{name}")
            yield batch.select([0])

    files.select("file_name", "payload").mapInArrow(save, "file_name string").write.format("noop").mode("overwrite").save()


def _uri(folder: str) -> str:
    return re.sub("^file:/(?!/)", "file:///", folder.rstrip("/"))


def _store(target: str):
    """The file system and the folder of ``target``, which is made if it is not there."""
    from pyarrow import fs
    store, folder = fs.FileSystem.from_uri(target)
    store.create_dir(folder, recursive=True)
    return store, folder


def read_payload_files(names: DataFrame, out_dir: str) -> DataFrame:
    """(file_name, payload): the named files of a folder that ``write_payload_files`` filled.

    Names may hold what Spark's own readers do not take in a path (a colon), so tasks open them by name."""
    target = _uri(out_dir)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():  # one file in memory at a time
                with store.open_input_stream(f"{folder}/{name}") as file:
                    yield pa.record_batch([pa.array([name], pa.string()), pa.array([file.read()], pa.binary())], ["file_name", "payload"])

    return names.select("file_name").mapInArrow(load, "file_name string, payload binary")


# F23
def result_record_columns(original_tokens: int = 576, method: str = "pruned_embeddings"):
    """Record fields with the reference's defaults: failed calls keep empty
    text, false correctness, 0 tokens and an error message."""
    ok = F.col("api_success")
    return [
        ok.alias("api_success"),
        F.when(ok, F.col("generated_text")).otherwise(F.lit("")).alias("generated_text"),
        F.when(ok, F.col("predicted_answer")).otherwise(F.lit("")).alias("predicted_answer"),
        (ok & F.col("is_correct")).alias("is_correct"),
        F.when(ok, F.lit("")).otherwise(F.lit("Failed to get response")).alias("error_message"),
        F.lit(original_tokens).alias("original_token"),
        F.when(ok, F.col("pruned_token")).otherwise(F.lit(0)).alias("pruned_token"),
        F.lit(method).alias("method"),
    ]
