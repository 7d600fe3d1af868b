"""Token-id files in Simple-8b, written and read back by Spark.

File format: a Parquet table of blocks; ``part`` and ``block`` give their
order, which is document order. A block holds the ids of whole documents:
``words`` is the blob of little-endian 64-bit words,
``starts`` the word index and ``lengths`` the id count of each document, so
any document, or all at once, can be decoded without a scan. The top four
bits of a word select how many ids of how many bits its other 60 bits hold,
the first id lowest; selector 0 is the escape: the next word is one id as it
is (ids of more than 60 bits). A document starts on a word of its own.

Defined results: a null text is an empty one (the end id alone); repeated
documents are written one after the other in no set order; an empty table
writes no block; only ``doc_id`` and ``text`` are read. Null ``doc_id`` sorts
first.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder, spread, text_or_empty
from .tokens import default_vocab, encoder, shared_vocab

#: Bits an id may have under selectors 1 to 15; 60 // bits ids fit.
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60)
#: Ids that close a block.
BLOCK_IDS = 1 << 16
#: Bytes of text whose ids one writing task should get, and the most tasks.
TASK_BYTES = 32 << 20
MAX_PARTS = 20_000


def encode_ids(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words (uint64) of documents' ids, one after the other, and
    how many words each document takes.

    Each word takes as many ids as any selector allows. The choice at every
    position is found for all positions at once; following the choices from
    the start gives the words.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(lengths), np.int64)
    ends = np.cumsum(lengths)
    room = np.minimum(np.repeat(ends, lengths) - np.arange(n), 60).astype(np.uint8)
    # the narrowest selector that holds an id, less one; 14: none does
    top = int(ids.max()).bit_length()
    small = ids.astype(np.uint32) if top <= 32 else ids
    widest = np.zeros(n, np.uint8)
    for bits in BITS[:-1]:
        if bits < top:
            widest += small >= 1 << bits
    own, which, span = widest.copy(), np.zeros(n, np.uint8), 1
    for k in reversed(range(len(BITS) - 1)):
        # of the next ids, as many as the selector holds or the document has left
        for span in range(span + 1, 60 // BITS[k] + 1):
            np.maximum(widest[:1 - span], own[span - 1:] * (room[:1 - span] >= span), out=widest[:1 - span])
        fits = widest <= k
        if not fits.any() and BITS[k] < top:
            break  # nor under a narrower one
        which[fits] = k + 1
    best = np.minimum(np.array([1, *(60 // b for b in BITS)], np.uint8)[which], room)
    step = best.tobytes()
    heads, p = [], 0
    while p < n:
        heads.append(p)
        p += step[p]
    heads = np.array(heads)
    kind, held = which[heads], best[heads].astype(np.int64)
    size = np.where(kind == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in np.unique(kind):
        chosen = np.flatnonzero(kind == k)
        own, to = heads[chosen], place[chosen]
        if k == 0:
            words[to + 1] = ids[own]
            continue
        places = np.arange(min(60 // BITS[k - 1], int(held[chosen].max())))
        parts = ids[np.minimum(own[:, None] + places, n - 1)] << (places * BITS[k - 1]).astype(np.uint64)
        parts[places >= held[chosen, None]] = 0
        words[to] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(int(k) << 60)
    first = np.searchsorted(heads, np.concatenate(([0], ends)))
    return words, np.diff(np.append(place, len(words))[first])


def decode_words(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids (uint64) of a block's documents, one after the other."""
    words = words.astype(np.uint64)
    if not len(words):
        return np.empty(0, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = _raw_words(kind)
    # the selector gives a word's capacity; a document's last word may hold less
    capacity = np.array([1, *(60 // b for b in BITS)])[kind]
    capacity[raw] = 0
    before = np.cumsum(capacity) - capacity
    ends = np.append(starts[1:], len(words))
    doc_of = np.repeat(np.arange(len(starts)), ends - starts)
    inside = before - np.append(before, 0)[starts][doc_of]
    held = np.minimum(capacity, lengths[doc_of] - inside)
    first = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint64)
    to = first[doc_of] + inside
    for k in np.unique(kind[~raw]):
        own = np.flatnonzero((kind == k) & ~raw)
        if k == 0:
            out[to[own]] = words[own + 1]
            continue
        bits, places = BITS[k - 1], np.arange(min(60 // BITS[k - 1], int(held[own].max())))
        there = places < held[own, None]
        parts = words[own, None] >> (places * bits).astype(np.uint64) & np.uint64((1 << bits) - 1)
        out[(to[own, None] + places)[there]] = parts[there]
    return out


def _raw_words(kind: np.ndarray) -> np.ndarray:
    """True for words that follow an escape and so have no selector."""
    raw = np.zeros(len(kind), bool)
    for p in np.flatnonzero(kind == 0):
        if not raw[p]:
            raw[p + 1] = True
    return raw


def coded_documents(docs: DataFrame, vocab_path: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, words, _part: each whole text tokenised and coded,
    and how many of ``bounds`` are at or below its id (null: 0).

    The part is told by the task that codes, as a function of its own would
    run in further workers, each with a store of ids of its own.
    """
    vocab = shared_vocab(docs.sparkSession, vocab_path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            for rows, ids, lengths in enc.chunks(batch.column(0), batch.column(1), end_id):
                words, sizes = encode_ids(ids, lengths)
                data, ends = words.astype("<u8").tobytes(), 8 * np.cumsum(sizes)
                blobs = [data[b - a:b] for a, b in zip((8 * sizes).tolist(), ends.tolist())]
                part = np.zeros(len(rows), np.int32)
                if len(bounds):
                    known = rows.is_valid().to_numpy(zero_copy_only=False)
                    part[known] = np.searchsorted(bounds, rows.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), side="right")
                yield pa.record_batch([rows, pa.array(lengths), pa.array(blobs, pa.binary()), pa.array(part)], ["doc_id", "n_tokens", "words", "_part"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(code, f"doc_id {kind}, n_tokens long, words binary, _part int")


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, vocab_path: str | None = None) -> None:
    """Writes the file format to ``path`` in ascending (integer) ``doc_id``.

    The bounds between parts are quantiles of ``doc_id``, taken from that
    column alone, so that texts are tokenised once.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(spread(size, TASK_BYTES), MAX_PARTS)
    bounds = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(bounds, np.int64))
    coded = coded_documents(docs, vocab_path or default_vocab(), end_id, bounds)
    kind = coded.schema["doc_id"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, part, block = [], 0, TaskContext.get().partitionId(), 0

        def closed():
            words = [np.frombuffer(w, "<u8") for _, _, w in held]
            at = np.cumsum([0, *map(len, words)])[:-1]
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([block], pa.int64()),
                pa.array([[d for d, _, _ in held]], pa.list_(id_type)),
                pa.array([at.tolist()], pa.list_(pa.int64())),
                pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
                pa.array([b"".join(w for _, _, w in held)], pa.binary()),
            ], ["part", "block", "doc_ids", "starts", "lengths", "words"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                ids += row[1]
                if ids >= BLOCK_IDS:
                    yield closed()
                    held, ids, block = [], 0, block + 1
        if held:
            yield closed()

    ordered = coded.repartitionById(len(bounds) + 1, "_part").drop("_part").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, f"part int, block long, doc_ids array<{kind.simpleString()}>, starts array<long>, lengths array<long>, words binary") \
        .write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded from the files.

    ``start``, the ids of all documents before, is a running sum of block
    totals (within a part, then over parts) plus the place in the block.
    """
    blocks = spark.read.parquet(path)
    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(2).type.value_type
            for part, block, docs, starts, lengths, words in zip(*batch.columns):
                n = np.array(lengths.as_py(), np.int64)
                ids = decode_words(np.frombuffer(words.as_py(), "<u8"), np.array(starts.as_py(), np.int64), n).astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k:e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.record_batch([pa.array([part.as_py()] * len(n), pa.int32()), pa.array([block.as_py()] * len(n), pa.int64()),
                                       pa.array(docs.as_py(), id_type), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                                      ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(decode, f"part int, block long, doc_id {id_kind}, inside long, n_tokens long, ids_crc32 long")
    totals = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("_n"))
    by_part = totals.groupBy("part").agg(F.sum("_n").alias("_n"))  # at most MAX_PARTS rows
    earlier = (Window.unboundedPreceding, -1)
    part_first = by_part.select(F.col("part").alias("_p"), F.coalesce(
        F.sum("_n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("_part_first"))
    block_first = totals.select(F.col("part").alias("_q"), F.col("block").alias("_b"), F.coalesce(
        F.sum("_n").over(Window.partitionBy("part").orderBy("block").rowsBetween(*earlier)), F.lit(0)).alias("_block_first"))
    first = block_first.join(part_first, F.col("_q") == F.col("_p")).select(
        "_q", "_b", (F.col("_part_first") + F.col("_block_first")).alias("_first"))
    return rows.join(first, (F.col("part") == F.col("_q")) & (F.col("block") == F.col("_b"))).select(
        "doc_id", (F.col("_first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, end_id: int = 2, vocab_path: str | None = None) -> DataFrame:
    """Writes ``docs`` to files in the shared folder and reads them back:
    doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_folder(docs.sparkSession)}/tokensieve/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, end_id, vocab_path)
    return read_token_files(docs.sparkSession, path)
