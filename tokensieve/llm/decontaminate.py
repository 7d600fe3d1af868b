"""Benchmark passages in documents, by q-gram lemma filtering.

An item of m characters that occurs with at most e edits shares at least
m + 1 - q - e * q character q-grams with the region, all on e + 1 neighbouring
diagonals. Each document's q-grams are looked up among the items' q-grams,
matches are counted in overlapping bands of diagonals, and bands that meet
the bound are verified by banded alignment of the whole item. Case and the
kind of white space do not count. Matches are counted from the ends of the
runs that they form along a diagonal, and bands that overlap are aligned as
one, so a text or item that repeats one q-gram costs no more than its length
times the item's.

The benchmark is taken in blocks of bounded size, each shipped to the tasks
that read the documents; documents are never shuffled.

Items with fewer than ``q`` characters have no q-gram. They are looked up as
they are, without edits, where no letter or digit goes on at either end.

Defined results: null texts on either side match nothing, nor do items of
white space alone with fewer than ``q`` characters; an item's budget is lowered until its
bound is one shared q-gram at least; repeated documents and items are
reported once for each pair of rows; an empty table on either side gives no
rows. Of an item's places in a text the one of fewest edits counts, of these
the one that ends first. Very long texts are searched whole, each alone. Only
``doc_id``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of benchmark text that go to a task at once.
BLOCK_CHARS = 4_000_000
#: Characters of documents filtered together in a task.
TOGETHER = 1_000_000
#: and how many of them at most (their number takes 13 bits of a key).
MOST = 1 << 13
TABLE_BITS = 23
#: Ends of runs counted at once, and diagonals aligned at once.
RUNS = 1 << 20
WIDEST = 1 << 16


def folded(text: str) -> str:
    """Lower case, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def codes(text: str) -> np.ndarray:
    """Code points of a folded text, white space as one kind."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c[(c >= 9) & (c <= 13) | (c == 160)] = 32
    return c


def wordy(c: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits."""
    found, at = np.unique(c, return_inverse=True)
    return np.array([chr(x).isalnum() for x in found.tolist()], bool)[at]


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A mixed 64-bit number for the q-gram at each place."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[k:k + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def budget(m: int, share: float, q: int) -> int:
    """Edits that an item of m characters may have."""
    return max(0, min(int(share * m), (m - q) // q))


def aligned(item: np.ndarray, region: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, end, start) of the item's best place in the region, if at most
    ``most`` edits; cells outside diagonals ``low`` to ``low + width`` (text
    place less item place) are left out. The earliest end wins a tie."""
    far = np.int32(1 << 28)
    m, n = len(item), width + 1
    # the region along the first row's diagonals and on to the last row's
    place = np.arange(low, low + n + m)
    text = np.full(n + m, -1, np.int64)
    held = (place >= 0) & (place < len(region))
    text[held] = region[place[held]]
    outside = (place < 0) | (place > len(region))
    ramp = np.arange(n, dtype=np.int32)
    # row 0: an occurrence may start at any place of the region
    cost = np.where(outside[:n], far, np.int32(0))
    origin = ramp
    for i in range(1, m + 1):
        step = cost + (text[i - 1:i - 1 + n] != np.int64(item[i - 1]))
        step[text[i - 1:i - 1 + n] < 0] = far
        above = np.append(cost[1:] + np.int32(1), far)
        take = above < step
        new = np.where(take, above, step)
        new[outside[i:i + n]] = far
        start = np.where(take, np.append(origin[1:], np.int32(0)), origin)
        # moving along the text: the least of earlier cells plus the distance
        slope = new - ramp
        lead = np.minimum.accumulate(slope)
        better = lead < slope
        if better.any():
            first = np.maximum.accumulate(np.where(better, np.int32(0), ramp))
            start = np.where(better, start[first], start)
            new = np.where(better & ~outside[i:i + n], lead + ramp, new)
        cost, origin = np.minimum(new, far), start
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), low + k + m, low + int(origin[k])) if cost[k] <= most else None


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from first to last (exclusive) of each pair, and its pair."""
    n = last - first
    pair = np.repeat(np.arange(len(n)), n)
    return pair, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[pair]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of equal keys added up, by key."""
    own, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(own), np.int64)
    np.add.at(out, at, values)
    return own, out


class Items:
    """A block of benchmark items, ready to look up."""

    def __init__(self, items: list[tuple], q: int, share: float):
        kept = [(k, codes(folded(t))) for k, t in items if t is not None]
        short = [(k, c) for k, c in kept if len(c) < q and (c != 32).any()]
        kept = [(k, c) for k, c in kept if len(c) >= q]
        self.q = q
        self.ids = [k for k, _ in kept + short]
        self.codes = [c for _, c in kept]
        length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(m, share, q) for m in length.tolist()], np.int64)
        self.bound = length + 1 - q - self.edits * q
        h = np.concatenate([grams(c, q) for c in self.codes] or [np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(kept)), length + 1 - q)
        place = np.arange(len(h)) - np.repeat(np.cumsum(length + 1 - q) - (length + 1 - q), length + 1 - q)
        self.keys, key = np.unique(h, return_inverse=True)
        #: What a diagonal is raised by to be positive.
        self.raised = int(length.max(initial=0))
        #: For the gram before (0) and after (1): the grams of all items by (key, that gram's key or -2).
        self.sides = []
        for by in (-1, 1):
            next_to = np.roll(key, -by)
            next_to[place == (0 if by < 0 else (length - q)[item])] = -2
            pair = self.paired(key, next_to)
            order = np.argsort(pair, kind="stable")
            self.sides.append((pair[order], item[order], place[order]))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - TABLE_BITS)] = True
        #: By length: the short items' hashes in order, their numbers and code points.
        self.short = {}
        for m in sorted({len(c) for _, c in short}):
            own = [i for i, (_, c) in enumerate(short) if len(c) == m]
            rows = np.stack([short[i][1] for i in own])
            h = np.concatenate([grams(c, m) for c in rows])
            order = np.argsort(h, kind="stable")
            self.short[m] = h[order], np.array(own)[order] + len(kept), rows[order]

    def paired(self, key: np.ndarray, next_to: np.ndarray) -> np.ndarray:
        return key * (len(self.keys) + 2) + next_to + 2

    def strips(self, h: np.ndarray, inside: np.ndarray, doc_of) -> tuple[np.ndarray, ...]:
        """Items, documents, numbers and match counts of the strips of
        ``edits + 1`` diagonals that hold a match, in this order.

        Equal q-grams that go on along a diagonal are a run, which starts where
        the q-grams before differ and stops where those after do; only such
        pairs are made, and the places after the stops less the starts add up
        to the matches."""
        hit = np.flatnonzero(inside & self.table[h >> np.uint64(64 - TABLE_BITS)])
        key = np.searchsorted(self.keys, h[hit])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == h[hit]
        hit, key = hit[same], key[same]
        found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(hit):
            return found, found, found, counts
        touch = np.diff(hit) == 1
        before = np.where(np.append(False, touch), np.append(-1, key[:-1]), -1)
        after = np.where(np.append(touch, False), np.append(key[1:], -1), -1)
        for (pairs, items, places), next_to, sign in zip(self.sides, (before, after), (-1, 1)):
            first = np.searchsorted(pairs, self.paired(key, np.full(len(key), -2)))
            last = np.searchsorted(pairs, self.paired(key, np.full(len(key), len(self.keys))), side="left")
            skip, on = np.searchsorted(pairs, self.paired(key, next_to)), np.searchsorted(pairs, self.paired(key, next_to), side="right")
            total = np.cumsum(last - first - (on - skip))
            cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]), RUNS)), len(key)))
            for a, b in zip(np.append(0, cuts), cuts):
                for low, high in ((first, skip), (on, last)):
                    which, row = _ranges(low[a:b], high[a:b])
                    pos, item = hit[a:b][which], items[row]
                    strip = (pos - places[row] + self.raised) // (self.edits[item] + 1)
                    packed = (item << 44) | (doc_of(pos) << 31) | strip
                    own, value = _summed(packed, sign * pos + (sign > 0))
                    found, counts = _summed(np.append(found, own), np.append(counts, value))
        return found >> 44, (found >> 31) & (MOST - 1), found & ((1 << 31) - 1), counts

    def bands(self, h: np.ndarray, inside: np.ndarray, doc_of) -> Iterator[tuple[int, int, int, int]]:
        """(item, document, lowest and highest diagonal) of bands of two strips
        that meet the item's bound, those that overlap taken together."""
        item, doc, strip, number = self.strips(h, inside, doc_of)
        if not len(item):
            return
        goes_on = (item[1:] == item[:-1]) & (doc[1:] == doc[:-1]) & (strip[1:] == strip[:-1] + 1)
        number[:-1] += np.where(goes_on, number[1:], 0)
        kept = number >= self.bound[item]
        item, doc, edits = item[kept], doc[kept], self.edits[item[kept]]
        low = strip[kept] * (edits + 1) - self.raised - edits
        own = None
        for i, d, a, b in zip(item.tolist(), doc.tolist(), low.tolist(), (low + 4 * edits + 2).tolist()):
            if own and own[:2] == (i, d) and a <= own[3] and b - own[2] < WIDEST:
                own = (i, d, own[2], b)
                continue
            if own:
                yield own
            own = (i, d, a, b)
        if own:
            yield own

    def whole(self, line: np.ndarray, doc_of) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start, end) of each short item that stands alone."""
        for m, (keys, item, rows) in self.short.items():
            h = grams(line, m)
            first, last = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
            pos = np.flatnonzero(last > first)
            # an end that is a letter or digit must not go on
            before = wordy(line[pos]) & wordy(np.where(pos > 0, line[pos - 1], 0))
            after = wordy(line[pos + m - 1]) & wordy(line[np.minimum(pos + m, len(line) - 1)])
            pos = pos[~before & ~after]
            n = last[pos] - first[pos]
            row = np.repeat(first[pos], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(pos, n)
            same = (line[pos[:, None] + np.arange(m)] == rows[row]).all(axis=1)
            pos, row = pos[same], row[same]
            yield from zip(doc_of(pos).tolist(), item[row].tolist(), pos.tolist(), (pos + m).tolist())

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every item found."""
        if not len(self.keys) and not self.short:
            return []
        c = [codes(folded(t)) for t in texts]
        gap = np.zeros(self.q, np.uint64)
        line = np.concatenate([x for own in c for x in (own, gap)])
        starts = np.cumsum([0, *(len(own) + self.q for own in c)])[:-1]
        doc_of = lambda p: np.searchsorted(starts, p, side="right") - 1
        best: dict[tuple[int, int], tuple] = {}
        if len(self.keys):
            h = grams(line, self.q)
            inside = np.ones(len(h), bool)
            for own, start in zip(c, starts.tolist()):
                inside[max(start, start + len(own) - self.q + 1):start + len(own) + self.q] = False
            for item, doc, low, high in self.bands(h, inside, doc_of):
                low, high = low - int(starts[doc]), high - int(starts[doc])
                old = best.get((doc, item))
                # a place without edits that ends before any of this band's
                if old and old[0] == 0 and old[1] < low + len(self.codes[item]):
                    continue
                found = aligned(self.codes[item], c[doc], low, high - low, int(self.edits[item]))
                if found and (not old or found < old):
                    best[doc, item] = found
        for doc, item, start, end in self.whole(line, doc_of):
            start, end = start - int(starts[doc]), end - int(starts[doc])
            if end <= len(c[doc]) and ((doc, item) not in best or (0, end, start) < best[doc, item]):
                best[doc, item] = (0, end, start)
        return [(doc, item, start, end, n) for (doc, item), (n, end, start) in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_CHARS)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.06, q: int = 12) -> DataFrame:
    """doc_id, item_id, start, end, edits: the best place of every item found
    in a document with at most ``share`` of its characters edited."""
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, start long, end long, edits int"

    def scan(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(block, q, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                at = 0
                while at < len(texts):
                    upto, size = at, 0
                    while upto < len(texts) and upto - at < MOST and (upto == at or size + len(texts[upto]) <= TOGETHER):
                        size += len(texts[upto])
                        upto += 1
                    hits = items.search(texts[at:upto])
                    yield pa.record_batch([
                        ids.take(pa.array([at + h[0] for h in hits], pa.int64())),
                        pa.array([items.ids[h[1]] for h in hits], item_type),
                        *(pa.array([h[k] for h in hits], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32()))),
                    ], ["doc_id", "item_id", "start", "end", "edits"])
                    at = upto

        from pyspark.sql.pandas.types import to_arrow_type
        item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
        return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, schema)

    found = [scan(b) for b in _blocks(benchmark) if b]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
