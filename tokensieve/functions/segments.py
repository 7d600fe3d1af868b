"""Token-sequence windows over text (V16, V17) on whitespace tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITESPACE_RE = "[ \\t\\n\\r\\f]+"
PAD = ""


def words(text) -> "F.Column":
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(c, WHITESPACE_RE), lambda x: x != "")


# V16
def text_segments(df: DataFrame, key: str, text: str, max_len: int) -> DataFrame:
    """Split each whole text into ``(len-1)//max+1`` windows of ``max_len``
    tokens; the last window is padded to ``max_len`` (``n_real`` counts
    real tokens).  One row per window; no text is cut short."""
    w = df.select(key, words(text).alias("_t")).where(F.size("_t") > 0)
    n = F.size("_t")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / max_len).cast("int"))
    parts = F.transform(starts, lambda i: F.slice("_t", i * max_len + 1, max_len))
    segs = w.select(key, F.posexplode(parts).alias("seg_idx", "_part"))  # a row holds its own window only
    part = F.col("_part")
    return segs.select(
        key, F.col("seg_idx").cast("int").alias("seg_idx"), F.size(part).cast("int").alias("n_real"),
        F.array_join(part, " ").alias("seg_text"),
        F.concat(part, F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size(part))).alias("tokens"),
    )


# V17
def truncate_sequence(df: DataFrame, batch: str, text: str, max_len: int) -> DataFrame:
    """Truncate each text to ``max_len`` tokens; pad to the longest in its batch."""
    t = df.select("*", F.slice(words(text), 1, max_len).alias("_t"))
    t = t.withColumn("n_kept", F.size("_t").cast("int"))
    longest = t.groupBy(batch).agg(F.max("n_kept").cast("int").alias("padded_len"))
    out = t.join(longest, batch)
    return out.withColumn("tokens", F.concat("_t", F.array_repeat(F.lit(PAD), F.col("padded_len") - F.col("n_kept")))) \
        .drop("_t")
