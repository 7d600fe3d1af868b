"""Removal of every byte in a repeated ``length``-byte string, corpus-wide.

The windows (suffixes cut at the threshold) are ordered by radix passes over
nested digits, most significant first; after each pass groups of one are
dropped, and the equal groups left after the last are exactly the repeated
windows:

1. a window's anchor: its least ``gram``-byte string by hash (the leftmost of
   equal ones), which equal windows share at the same place. Neighbouring
   windows mostly share an anchor and travel as one run;
2. the run's whole context. Runs that agree in it are repeated as
   a whole and go on as one representative;
3. the window itself, for runs whose anchor occurs in several contexts.

A pass is a count per digit, combined before the shuffle, and a join with the
repeated digits; digits are 64-bit hashes, and a window must agree in all three.
Groups of up to ``together`` contexts are compared inside tasks. Larger ones
take the third digit in steps, each a count and a join: blocks of windows
at equal distances from the anchor, the bytes that all windows of a block have
in common, then the single windows of one block of each kind.

Defined results: a null text is an empty one; texts under ``length`` bytes
have no window; rows that agree in ``doc_id`` and ``text`` repeat each other
like any copies, rows that share a ``doc_id`` alone are told apart by their
text; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Windows of a long text that are handled at once.
SEGMENT = 4_000_000
#: Windows of a block, in groups too large for one task.
BLOCK = 16
_PLACE = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


class Rolling:
    """Hashes of any substrings, from prefix sums modulo 2**64."""

    def __init__(self, seed: int = 11):
        self.values = np.random.default_rng(seed).integers(1, 1 << 64, 256, np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)))) for b in (_ODD, _BACK))
        out = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self.up[:n - 1], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        h = (prefix[start + length] - prefix[start]) * self.down[start] + np.uint64(length)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


def runs(data: np.ndarray, rolling: Rolling, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, windows, place of the anchor after it, anchor hash,
    context hash) of the runs of a text."""
    w = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[at:at + SEGMENT + length - 1]
        prefix = rolling.prefix(part)
        h = rolling.of(prefix, np.arange(len(part) - gram + 1), gram)
        key = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
        n = len(h) - w + 1
        padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max)
        padded[:len(h)] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = np.minimum(back[:n], ahead[w - 1:w - 1 + n]) & _PLACE
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(first, n))
        context = (prefix[first + count - 1 + length] - prefix[first]) * rolling.down[first]
        context ^= context >> np.uint64(31)
        place = anchor[first].astype(np.int64)
        yield first + at, count, place - first, h[place], context * np.uint64(_ODD) + count.astype(np.uint64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted, with touching and overlapping ones as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _longs(*arrays) -> list[pa.Array]:
    return [pa.array(np.asarray(a).astype(np.int64, copy=False) if np.asarray(a).dtype != np.uint64 else np.asarray(a).view(np.int64)) for a in arrays]


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 50, together: int = 500) -> DataFrame:
    """(doc, own, start, end): byte spans covered by repeated windows, one row
    for each run or window, overlapping. ``docs`` has (doc, own, data)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            found, at = [], []
            for i, data in enumerate(batch.column(2)):
                for run in runs(np.frombuffer(data.as_buffer(), np.uint8), rolling, length, gram):
                    found.append(run)
                    at.append(np.full(len(run[0]), i))
            if found:
                rows = pa.array(np.concatenate(at))
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), *_longs(*map(np.concatenate, zip(*found)))],
                                      ["doc", "own", "at", "n", "o", "h", "c"])

    def only_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in anchors(batches):
            h, n = np.unique(batch.column(5).to_numpy(), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(n)], ["h", "n"])

    # first digit
    counted = docs.mapInArrow(only_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = written(counted.where("n > 1").select(F.col("h").alias("_h")), "often")
    found = docs.mapInArrow(anchors, f"doc {kind}, own long, at long, n long, o long, h long, c long")
    found = written(found.join(often, F.col("h") == F.col("_h")).drop("_h"), "anchors")
    # second digit
    classes = written(found.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "own", "at", "n", "o")).alias("r")), "contexts")
    copied = written(classes.where("copies > 1").select(F.col("h").alias("_h"), F.col("c").alias("_c")), "copied")
    whole = found.join(copied, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c"))).select(
        "doc", "own", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))
    # third digit, for the representatives of anchors with several contexts
    groups = written(classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select(F.col("h").alias("_h"), "m"), "groups")
    wanted = classes.join(groups, F.col("h") == F.col("_h")).select("r.*", "h", "copies", "m")
    wanted = wanted.groupBy(F.col("doc").alias("_doc"), F.col("own").alias("_own")).agg(
        F.collect_list(F.struct("at", "n", "o", "h", "copies", "m")).alias("wanted"))
    in_text = docs.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")))
    in_text = in_text.select("doc", "own", F.explode("wanted").alias("w"), F.expr(f"substring(data, cast(w.at as int) + 1, cast(w.n as int) + {length} - 1)").alias("bytes"))
    contexts = written(in_text.select("doc", "own", "w.*", "bytes"), "bytes")

    def window_hashes(batch: pa.RecordBatch, rolling: Rolling):
        """Row and window number and hash of every window of the contexts."""
        data = batch.column("bytes")
        sizes = np.fromiter((len(x) for x in data.to_pylist()), np.int64, len(data))
        prefix = rolling.prefix(np.frombuffer(b"".join(data.to_pylist()), np.uint8))
        n = sizes - length + 1
        row = np.repeat(np.arange(len(n)), n)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return row, number, rolling.of(prefix, np.repeat(np.cumsum(sizes) - sizes, n) + number, length)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()

        def settled(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, number, h = window_hashes(batch, rolling)
            _, back, n = np.unique(h, return_inverse=True, return_counts=True)
            ok = (n[back] > 1) & (batch.column("copies").to_numpy()[row] == 1)
            row, start = row[ok], batch.column("at").to_numpy()[row[ok]] + number[ok]
            # neighbouring windows of a row as one span
            cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(start) != 1)) + 1
            first, last = np.concatenate(([0], cut)), np.append(cut, len(row)) - 1
            if not len(row):
                first = last = np.empty(0, np.int64)
            rows = pa.array(row[first])
            return pa.record_batch([batch.column("doc").take(rows), batch.column("own").take(rows), *_longs(start[first], start[last] + length)],
                                   ["doc", "own", "start", "end"])

        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = held.column("h").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on
            if cut >= 4000:
                yield settled(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield settled(held)

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of up to BLOCK windows at equal distances from the anchor."""
        rolling = Rolling()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                data = part.column("bytes").to_pylist()
                row, number, _ = window_hashes(part, rolling)
                ahead = part.column("o").to_numpy()[row] - number
                first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(ahead // BLOCK) != 0))))
                size = np.diff(np.append(first, len(row)))
                sizes = np.fromiter(map(len, data), np.int64, len(data))
                begin = (np.cumsum(sizes) - sizes)[row[first]] + number[first]
                prefix = rolling.prefix(np.frombuffer(b"".join(data), np.uint8))
                key = rolling.of(prefix, begin, size - 1 + length) ^ (ahead[first].astype(np.uint64) * np.uint64(_ODD))
                # what all windows of the whole block have in common
                block = ahead[first] // BLOCK
                middle = (np.cumsum(sizes) - sizes + part.column("o").to_numpy())[row[first]] - BLOCK * block
                core = rolling.of(prefix, middle, length - BLOCK + 1) ^ (block.astype(np.uint64) * np.uint64(_ODD))
                rows = pa.array(row[first])
                blobs = [data[i][k:k + m - 1 + length] for i, k, m in zip(row[first].tolist(), number[first].tolist(), size.tolist())]
                yield pa.record_batch([part.column("doc").take(rows), part.column("own").take(rows), part.column("copies").take(rows),
                                       *_longs(part.column("at").to_numpy()[row[first]] + number[first], size, key, core), pa.array(blobs, pa.binary())],
                                      ["doc", "own", "copies", "start", "size", "v", "core", "bytes"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                row, number, h = window_hashes(part, rolling)
                rows = pa.array(row)
                yield pa.record_batch([part.column("doc").take(rows), part.column("own").take(rows), part.column("alone").take(rows),
                                       *_longs(part.column("start").to_numpy()[row] + number, h)], ["doc", "own", "alone", "start", "v"])

    spans = f"doc {kind}, own long, start long, end long"
    few = contexts.where(F.col("m") <= together)
    few = few.repartition("h").sortWithinPartitions("h").select("doc", "own", "at", "h", "copies", "bytes").mapInArrow(compare, spans)
    # larger groups: blocks of windows first, whole; then the windows of one block of each kind
    many = contexts.where(F.col("m") > together).select("doc", "own", "at", "o", "copies", "bytes").mapInArrow(
        covers, f"doc {kind}, own long, copies long, start long, size long, v long, core long, bytes binary")
    many = written(many, "covers")
    kinds = written(many.groupBy("v", "core").agg(F.count("*").alias("n"), F.min(F.struct("doc", "own", "copies", "start", "bytes")).alias("r")), "covers")
    twice = written(kinds.where("n > 1").select(F.col("v").alias("_v")), "twice")
    blocks = many.where("copies = 1").join(twice, F.col("v") == F.col("_v")).select(
        "doc", "own", "start", (F.col("start") + F.col("size") - 1 + length).alias("end"))
    shared = written(kinds.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select(F.col("core").alias("_core")), "cores")
    windows = kinds.join(shared, F.col("core") == F.col("_core")).select("r.doc", "r.own", ((F.col("n") == 1) & (F.col("r.copies") == 1)).alias("alone"), "r.start", "r.bytes").mapInArrow(
        single, f"doc {kind}, own long, alone boolean, start long, v long")
    windows = written(windows, "windows")
    twice = written(windows.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select(F.col("v").alias("_v")), "twice")
    many = windows.where("alone").join(twice, F.col("v") == F.col("_v")).select("doc", "own", "start", (F.col("start") + length).alias("end"))
    many = many.unionByName(blocks)
    return whole.unionByName(few).unionByName(many)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 50, together: int = 500) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: maximal removed runs) and
    kept (the remaining bytes)."""
    source = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text_or_empty()).alias("own"), text_or_empty().cast("binary").alias("data"))
    spans = repeated_spans(source, length, gram, together)
    spans = spans.groupBy(F.col("doc").alias("_doc"), F.col("own").alias("_own")).agg(F.collect_list(F.struct("start", "end")).alias("s"))
    joined = source.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")), "left").select("doc", "data", "s")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for data, found in zip(batch.column(1), batch.column(2)):
                data = data.as_py()
                found = merged([(s["start"], s["end"]) for s in found.as_py() or []])
                at, parts = 0, []
                for a, b in found:
                    parts.append(data[at:a])
                    at = b
                sizes.append(len(data))
                gone.append([{"start": a, "end": b} for a, b in found])
                kept.append(b"".join([*parts, data[at:]]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, span), pa.array(kept, pa.binary())],
                                  ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
