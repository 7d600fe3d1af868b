"""Best-fit packing of token pieces by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Which lengths share a
bin is decided on the histogram of lengths alone, whose size ``capacity``
bounds whatever the corpus: each step takes the longest length left, finds by
bitset subset-sum dynamic programming the fullest combination of the lengths
still available that goes with it, and repeats that combination as often as
the counts allow. Spark then deals the pieces of each length to the slots the
plan holds for that length.

Defined results: a null text is an empty one, whose document is the end id
alone; repeated rows are packed separately; no input gives no rows; only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, text_or_empty, written
from .tokens import default_vocab, encoder, shared_vocab

#: Pieces numbered together by one window task.
NUMBERED_TOGETHER = 200_000


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as bytes when asked)."""
    vocab = shared_vocab(docs.sparkSession, vocab_path)
    width = 4 * capacity
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            for rows, all_ids, lengths in enc.chunks(batch.column(0), batch.column(1), end_id):
                data, ends = all_ids.astype("<u4").tobytes(), 4 * np.cumsum(lengths)
                cols = [[] for _ in range(6)]
                for doc, first, upto in zip(rows.to_pylist(), (ends - 4 * lengths).tolist(), ends.tolist()):
                    for k, at in enumerate(range(first, upto, width)):
                        piece = data[at:min(at + width, upto)]
                        for c, v in zip(cols, (doc, k, (at - first) // 4, len(piece) // 4, zlib.crc32(piece), piece)):
                            c.append(v)
                arrays = [pa.array(cols[0], rows.type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
                yield pa.record_batch(arrays, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)


def _fullest(left: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, how many) whose sum comes nearest to ``room`` from below.

    Bit s of ``reach`` says that a sum s can be made of the lengths looked at;
    ``steps`` keeps it before each added item, for walking back.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        if length > room:
            continue
        for _ in range(min(left[length], room // length)):
            more = (reach | reach << length) & full
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + 1
            at -= length
    return list(taken.items())


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, their (length, how many)) by minimum bin slack."""
    left = {k: n for k, n in counts.items() if n}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        longest = order[0]
        left[longest] -= 1
        rest = _fullest(left, [k for k in order if left[k]], capacity - longest)
        left[longest] += 1
        used = dict(rest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        plan.append((times, sorted(used.items(), reverse=True)))
        order = [k for k in order if left[k]]
    return plan


def pack(pieces: DataFrame, capacity: int, order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs a ``length`` of 1
    to ``capacity``. Two rows that agree in ``order_by`` may swap places."""
    spark: SparkSession = pieces.sparkSession
    total = pieces.count()
    salts = spread(total, NUMBERED_TOGETHER, 16)
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(salts)).cast("int"))
    by_salt = keyed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    first = by_salt.withColumn("_first", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce("_first", F.lit(0)).alias("_first"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, sequence = [], 0
    dealt: dict[int, int] = {}
    for times, used in plan_bins(counts, capacity):
        offset = 0
        for length, n in used:
            # pieces of this length numbered from `at` on fill n places in each of `times` bins
            at = dealt.get(length, 0)
            slots.append((length, at, at + n * times, n, sequence, offset))
            dealt[length] = at + n * times
            offset += n * length
        sequence += times
    spec = "array<struct<upto:long,at:long,n:long,sequence:long,offset:long>>"
    by_length: dict[int, list] = {}
    for length, at, upto, n, seq, off in slots:
        by_length.setdefault(length, []).append((upto, at, n, seq, off))
    places = spark.createDataFrame([(k, v) for k, v in by_length.items()] or [], f"_pl long, _slots {spec}")
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order_by)) - 1
    ranked = keyed.withColumn("_r", number.cast("long"))
    ranked = ranked.join(first, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_r", F.col("_r") + F.col("_first"))
    placed = ranked.join(F.broadcast(places), F.col("length") == F.col("_pl"))  # at most `capacity` rows
    slot = F.expr("filter(_slots, s -> s.at <= _r and _r < s.upto)[0]")
    placed = placed.withColumn("_slot", slot)
    within = F.col("_r") - F.col("_slot.at")
    return placed.select(
        *pieces.columns,
        (F.col("_slot.sequence") + F.floor(within / F.col("_slot.n"))).cast("long").alias("sequence_id"),
        (F.col("_slot.offset") + (within % F.col("_slot.n")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocab_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every
    document tokenised whole, ended by ``end_id``, cut and packed."""
    pieces = token_pieces(docs, vocab_path or default_vocab(), capacity, end_id)
    return pack(written(pieces, "pieces"), capacity)
