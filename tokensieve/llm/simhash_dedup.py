"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprints at most ``max_distance`` bits apart agree, in one of
``max_distance // 2 + 1`` segments, up to one bit. Each fingerprint is
indexed under every segment with each one bit of it left out; an equality
join on those keys verifies the distance of two fingerprints in its
condition, under the lowest key that both share, so a pair comes once.
Equal fingerprints are one row before the join.

Defined results: a null text is an empty one; a text without words has
fingerprint zero and links like any other; a repeated ``doc_id`` has one row
per row of the input, all in the component of each of its texts; an
empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .components import components

SEED = 42
#: Hashes whose bits are counted together.
COUNTED = 255 * 256


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles."""
    from xxhash import xxh64_intdigest
    found = text.lower().split()  # both know ASCII only, on bytes
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(found) - words + 1]
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1:].tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[at:at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits still fit a byte
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py().encode(), words) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(max_distance: int) -> list[list[int]]:
    """The bits of each segment."""
    n = max_distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:])]


def fingerprint_links(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """(a, b): distinct fingerprints a < b at most ``max_distance`` bits apart."""
    parts = segments(max_distance)
    masks = [_signed(sum(1 << b for b in bits)) for bits in parts]
    variants = [F.struct(F.lit(b).cast("byte").alias("bit"),
                         F.col("fp").bitwiseAND(F.lit(_signed(masks[k] & ~(1 << b) & (2**64 - 1)))).alias("rest"))
                for k, bits in enumerate(parts) for b in bits]
    keyed = fps.select("fp", F.explode(F.array(*variants)).alias("k")).select("fp", "k.bit", "k.rest")
    # a merge join whatever Spark takes the size to be: it counts an exploded row once, not once for each of its 64 keys
    left, right = keyed.alias("l"), keyed.hint("merge").alias("r")
    differ = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    apart = [F.bit_count(differ.bitwiseAND(F.lit(m))) for m in masks]
    lowest = F.lit(False)
    for k, bits in reversed(list(enumerate(parts))):
        # the first segment that differs by a bit at most; of its keys the differing bit's, or the first if none differs
        here = F.col("l.bit").between(bits[0], bits[-1]) & ((apart[k] == 1) | (F.col("l.bit") == bits[0]))
        lowest = F.when(apart[k] <= 1, here).otherwise(lowest)
    return left.join(right, (F.col("l.bit") == F.col("r.bit")) & (F.col("l.rest") == F.col("r.rest"))
                     & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(differ) <= max_distance) & lowest) \
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable by links, itself included)."""
    rows = written(fingerprints(docs, words), "fingerprints")
    groups = components(fingerprint_links(rows.select("fp").distinct(), max_distance))
    # one label for a class of equal fingerprints, then of linked ones
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    linked = first.join(groups, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), "_first", F.coalesce("component", "fp").alias("_class"))
    linked = written(linked, "classes")
    smallest = written(linked.groupBy("_class").agg(F.min("_first").alias("component_id")), "smallest")
    named = written(linked.join(smallest, "_class").select("_fp", "component_id"), "named")
    return rows.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
