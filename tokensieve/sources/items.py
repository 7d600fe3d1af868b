"""Item sources: projection scans, absent-column defaults, payload variants,
image paths and URLs (S1-S6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import global_row_number

# The eight columns of a multiple-choice item.
MC_COLUMNS = ("index", "question", "hint", "answer", "A", "B", "C", "D")
# Payload struct fields tried in this order.
PAYLOAD_FIELDS = ("bytes", "data", "binary")
# Extension -> mime sub-type of a data URL (default jpeg).
DATA_URL_FORMATS = (("png", "png"), ("jpg", "jpeg"), ("jpeg", "jpeg"), ("gif", "gif"), ("webp", "webp"))


NO_PAYLOAD = "error: unsupported payload"


# S1
def scan_items(df: DataFrame, columns=MC_COLUMNS, rename: dict | None = None) -> DataFrame:
    """Project the item columns; Catalyst prunes the parquet read to them."""
    rename = rename or {}
    return df.select(*[F.col(rename.get(c, c)).alias(c) for c in columns])


# S2
def scan_with_defaults(df: DataFrame, order_col: str, defaults: dict) -> DataFrame:
    """Supply a value for each column that is *absent* from the input.

    ``defaults`` maps column -> literal, or -> a prefix string ending in
    ``_`` that becomes ``<prefix><row>`` with the 0-based row position.
    The choice is made on the driver from the schema (plan time), so a
    present column is passed through untouched, nulls included.
    """
    missing = {c: d for c, d in defaults.items() if c not in df.columns}
    needs_row = any(isinstance(d, str) and d.endswith("_") and d != "" for d in missing.values())
    out = global_row_number(df, order_col, "_row") if needs_row else df
    for c, d in missing.items():
        if isinstance(d, str) and d.endswith("_"):
            val = F.concat(F.lit(d), (F.col("_row") - 1).cast("string"))
        else:
            val = F.lit(d)
        out = out.withColumn(c, val)
    return out.drop("_row") if needs_row else out


# S3
def payload_extract(payload: Column, fields=PAYLOAD_FIELDS) -> Column:
    """First present of ``payload.bytes / .data / .binary`` (struct input)."""
    return F.coalesce(*[payload.getField(f) for f in fields])


def payload_status(extracted: Column) -> Column:
    return F.when(extracted.isNull(), F.lit(NO_PAYLOAD)).otherwise(F.lit("ok"))


# S4
def image_path_lookup(items: DataFrame, order_col: str, index_col: str, base_dir: str) -> DataFrame:
    """``<base_dir>/<i-1>.jpg`` for the i-th item (1-based, in ``order_col``
    order); '' when the index is null or 0 (the reference's truthiness)."""
    numbered = global_row_number(items, order_col, "_i")
    idx = F.col(index_col)
    path = F.when(idx.isNull() | (idx == 0), F.lit("")).otherwise(
        F.concat(F.lit(base_dir.rstrip("/") + "/"), (F.col("_i") - 1).cast("string"), F.lit(".jpg")))
    return numbered.withColumn("sample_image_path", path).drop("_i")


# S5
def file_url(path: Column, base_dir: str) -> Column:
    """URLs unchanged; local paths as ``file://<absolute path>``."""
    absolute = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(base_dir.rstrip("/") + "/"), path))
    return F.when(path.rlike(r"^https?://"), path).otherwise(F.concat(F.lit("file://"), absolute))


# S6
def data_url(path: Column, payload: Column) -> Column:
    """``data:image/<fmt>;base64,<payload>`` with the format from the extension."""
    low = F.lower(path)
    fmt = None
    for ext, mime in DATA_URL_FORMATS:
        cond = low.endswith("." + ext)
        fmt = F.when(cond, F.lit(mime)) if fmt is None else fmt.when(cond, F.lit(mime))
    fmt = fmt.otherwise(F.lit("jpeg"))
    return F.when(payload.isNotNull(),
                  F.concat(F.lit("data:image/"), fmt, F.lit(";base64,"), base64_plain(payload)))


def base64_plain(payload: Column) -> Column:
    """Base64 on one line (Python's ``b64encode``); Spark may chunk with CRLF."""
    return F.replace(F.base64(payload), F.lit("\r\n"), F.lit(""))
