"""Collocations: phrases mined by partitioning (SON), scored exactly.

The tasks that read the documents are dealt to ``shards``; each writes its texts
as 32-bit hashes of words. A phrase that occurs ``support`` times in a language must, in
one shard at least, reach that support times the shard's share of the
language's words. So each shard is mined completely at this lowered support, all
shards side by side: phrases of one word first, then of two and so on, where a
longer one is counted only if both its parts of one word less are locally
frequent. Local counts are keyed by hashes and combined in each task before the
shuffle; what is locally frequent goes to the tasks of the next length as one bitmap of bounded
size (``MAX_BITS``). Equal hashes and the bitmap may let more through, never less. The
union of all shards is then counted over all documents by the words
themselves, so neither has a say in any count.

Defined results: a null text is empty, a null language ``und``; the same row
twice counts twice; an empty table gives no rows. Very long texts are read in
pieces of ``SLICE`` bytes, cut at a separator, with the last words carried on, so
nothing is cut off and memory stays bounded. Equal scores rank by a, then by the
phrase's bytes, which differ. Only ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LONGEST = 5
#: Words counted together (when mining, when counting exactly), texts read together, and words known by number at a time: each bounds a task's memory.
MINED, COUNTED, SLICE, VOCABULARY = 1 << 22, 1 << 19, 1 << 20, 1 << 18
#: Phrases are mined under hashes of 48 bits, which take less of a shuffle than 64.
MASK = np.uint64((1 << 48) - 1)
#: A bitmap has 16 bits for each key, 32 MB at most.
MAX_BITS = 1 << 28
#: Fixed values of the contract: A-Z in lower case, a tab is a space, piece separators as a byte that UTF-8 has not.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
STOP = b"\xff"


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys (a multiply-xorshift permutation)."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word, and that word's."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + word)


def place(h: np.ndarray, group: np.ndarray | int, bits: int) -> np.ndarray:
    """Where a key of a group stands in a bitmap of ``bits`` (a power of two)."""
    return mix((h & MASK) + np.asarray(group).astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(bits - 1)


def hit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words and stops of a text, a slice at a time."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            cuts = [c + 1 for c in (text.find(b" ", end), text.find(STOP, end)) if c >= 0]
            end = min(cuts, default=len(text))
        yield text[at:end].replace(STOP, b" \xff ").split()
        at = end


def word_hash(word: bytes) -> int:
    """32 bits, 0 for a stop only."""
    return 0 if word == STOP else xxhash.xxh32_intdigest(word) or 1


class Numbers(dict):
    """Hashes of words, each computed once while it is known."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = word_hash(word)
        return h


class Reader:
    """Numbers the words of a task's documents and hands them out in bounded blocks.

    A block is (ids, hashes, langs, fresh): 0 is a stop, and only phrases that
    end at ``fresh`` or later are new in it.
    """

    def __init__(self):
        self.forget()
        self.langs: list[str] = []
        self.salts: list[int] = []
        self.ids, self.lang, self.size, self.carried = [], [], 0, 0

    def forget(self):
        self.number = {STOP: 0}
        self.words, self.hashes = [STOP], [0]

    def number_of(self, words: list[bytes]) -> np.ndarray:
        for w in set(words).difference(self.number):
            self.number[w] = len(self.words)
            self.words.append(w)
            self.hashes.append(word_hash(w))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def add(self, ids: np.ndarray, lang: int):
        self.ids.append(ids)
        self.lang.append(np.full(len(ids), lang, np.int64))
        self.size += len(ids)

    def block(self):
        ids, lang = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.ids, self.lang))
        h = np.array(self.hashes, np.uint64)[ids]
        return ids, mix(h + np.array(self.salts, np.int64).view(np.uint64)[lang]) if len(ids) else h, lang, self.carried

    def next_block(self):
        """Starts a new block with the last words of this one, and with a new vocabulary if it is full."""
        ids, lang = (np.concatenate(x)[-(LONGEST - 1):] for x in (self.ids, self.lang))
        if len(self.words) > VOCABULARY:
            words = [self.words[i] for i in ids]
            self.forget()
            ids = self.number_of(words)
        self.ids, self.lang, self.size, self.carried = [ids], [lang], len(ids), len(ids)

    def blocks(self, batches: Iterator[pa.RecordBatch]):
        """Blocks over batches of (salt, lang, text)."""
        stop = np.zeros(1, np.int64)
        seen: dict[str, int] = {}
        for batch in batches:
            for salt, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lang not in seen:
                    seen[lang] = len(self.langs)
                    self.langs.append(lang)
                    self.salts.append(salt)
                for words in word_lists(text.encode()):
                    self.add(self.number_of(words), seen[lang])
                    if self.size > COUNTED:
                        yield self.block()
                        self.next_block()
                self.add(stop, seen[lang])
        yield self.block()


def longer_phrases(whole: np.ndarray, key: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From the places and hashes of phrases of ``size - 1`` words (``whole``, ``key``) those of one word more;
    ``h`` are the words' hashes. Both parts of a phrase must be among the shorter ones."""
    if len(whole) < 2:
        return np.empty(0, bool), np.empty(0, np.uint64)
    return whole[:-1] & whole[1:], joined(key[:-1], h[size - 1:])


def keyed(docs: DataFrame) -> DataFrame:
    """salt (of the language), lang, text of each document."""
    lang = F.coalesce("lang", F.lit("und"))
    return docs.select(F.xxhash64(lang).alias("salt"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def encoded(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, lang, salt, n, words): the texts as 32-bit hashes, 0 between pieces,
    a row for each slice; a slice begins with the last words of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        known = Numbers()
        for batch in batches:
            out = []
            for salt, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                last = np.empty(0, np.uint32)
                for words in word_lists(text.encode()):
                    h = np.concatenate([last, np.fromiter(map(known.__getitem__, words), np.uint32, len(words))])
                    last = h[-(LONGEST - 1):]
                    out.append((shard, lang, salt, int(np.count_nonzero(h)), h.astype("<u4").tobytes()))
                    if len(known) > VOCABULARY:
                        known.clear()
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["shard", "lang", "salt", "n", "words"])

    return written(rows.mapInArrow(run, "shard int, lang string, salt long, n long, words binary"), "phrase-words", "zstd")


def local_counts(words: DataFrame, size: int, before=None, bits: int = 0) -> DataFrame:
    """(g, h, n): parts of the local counts of phrases of ``size`` words; ``g`` is shard and language.

    ``before``: the broadcast bitmap of locally frequent phrases of one word less.
    """

    def counted(group: int, salt: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        h = mix(ids.astype(np.uint64) + np.array([salt], np.int64).view(np.uint64))
        whole, key = ids > 0, h
        for k in range(2, size + 1):
            if k == size:
                whole = whole.copy()
                whole[whole] = hit(before.value, place(key[whole], group, bits))
            whole, key = longer_phrases(whole, key, h, k)
        h, n = np.unique(key[whole] & MASK, return_counts=True)
        return pa.record_batch([pa.array(np.full(len(h), group, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["g", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        number, stop = 0, np.zeros(1, np.uint32)
        for batch in batches:
            for group, salt, words in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(words, "<u4")
                held.setdefault((group, salt), []).extend((ids, stop))
                number += len(ids)
                if number > MINED:
                    yield from (counted(*k, parts) for k, parts in held.items())
                    held, number = {}, 0
        yield from (counted(*k, parts) for k, parts in held.items())

    return words.select("g", "salt", "words").mapInArrow(run, "g int, h long, n long")


def bitmap(keys: DataFrame, count: int):
    """The broadcast bitmap of ``keys`` (g, h) and its number of bits.

    Tasks set the bits of one range each, so the driver gets each bit once."""
    bits = min(MAX_BITS, max(1 << 13, 1 << (16 * count - 1).bit_length()))
    ranges = max(1, bits >> 23)
    width = bits // ranges

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(1).to_numpy().view(np.uint64), batch.column(0).to_numpy(), bits).astype(np.int64)
            yield pa.record_batch([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], ["range", "at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            r, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(r):
                own.setdefault(int(k), np.zeros(width, np.uint8))[at[r == k]] = 1
        yield pa.record_batch([pa.array(list(own), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in own.values()], pa.binary())],
                              ["range", "bits"])

    parts = keys.select("g", "h").mapInArrow(positions, "range int, at int").repartition(ranges, "range").mapInArrow(pack, "range int, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for r, packed in parts.collect():  # MAX_BITS / 8 bytes at most
        table[r * width // 8:(r + 1) * width // 8] = np.frombuffer(packed, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table), bits


def candidate_hashes(rows: DataFrame, support: int, shards: int, longest: int) -> DataFrame | None:
    """(h): hashes of all phrases that are frequent in one shard at least."""
    words = encoded(rows, shards).withColumn("g", F.hash("shard", "lang"))
    per = words.groupBy("g", "lang").agg(F.sum("n").alias("own"))
    share = per.join(per.groupBy("lang").agg(F.sum("own").alias("whole")), "lang").where("whole > 0")
    # a row for each language of a shard; two under one hash take the lesser
    least = written(share.groupBy(F.col("g").alias("_g")).agg(F.min(F.lit(support) * F.col("own") / F.col("whole") * (1 - 1e-9)).alias("least")), "local-support")
    found, before, bits = [], None, 0
    for size in range(1, longest + 1):
        counts = local_counts(words, size, before, bits).groupBy("g", "h").agg(F.sum("n").alias("n"))
        level = written(counts.join(least, F.col("g") == F.col("_g")).where("n >= least").select("g", "h"), f"locally-frequent-{size}")
        count = level.count()
        if not count:
            break
        found.append(level.select("h"))
        if size < longest:
            before, bits = bitmap(level, count)
    if not found:
        return None
    union = found[0]
    for level in found[1:]:
        union = union.unionByName(level)
    return written(union.distinct(), "phrase-candidates")


def exact_counts(rows: DataFrame, candidates: DataFrame, longest: int) -> DataFrame:
    """(lang, words, phrase, n): every candidate counted by its words over all
    documents; the row of 0 words counts the language's words."""
    lookup, bits = bitmap(candidates.select(F.lit(0).alias("g"), "h"), candidates.count())

    def rows_of(langs, names, size, texts, n):
        lang = pa.DictionaryArray.from_arrays(pa.array(langs.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        return pa.record_batch([lang, pa.array(np.full(len(n), size, np.int32)), pa.array(texts, pa.string()), pa.array(n)], ["lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for ids, h, lang, fresh in reader.blocks(batches):
            whole, key = ids > 0, h
            n = np.bincount(lang[fresh:][whole[fresh:]])
            if len(n):
                has = np.flatnonzero(n)
                yield rows_of(has, reader.langs, 0, [""] * len(has), n[has])
            for size in range(1, longest + 1):
                if size > 1:
                    whole, key = longer_phrases(whole, key, h, size)
                # a phrase whose part is no candidate is none
                whole = whole.copy()
                whole[whole] = hit(lookup.value, place(key[whole], 0, bits))
                at = np.flatnonzero(whole)
                at = at[at + size > fresh]
                if len(at):
                    first, n = _same(ids, lang, key, at, size)
                    texts = [b" ".join([reader.words[i] for i in place]).decode() for place in ids[first[:, None] + np.arange(size)].tolist()]
                    yield rows_of(lang[first], reader.langs, size, texts, n)

    parts = rows.mapInArrow(run, "lang string, words int, phrase string, n long")
    return parts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _same(ids: np.ndarray, lang: np.ndarray, key: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different phrases at ``at``, and how often each is there.
    Grouped by hash; where a hash stands for two phrases, by their words."""
    _, first, group, n = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
    like = at[first][group]
    if all((ids[at + k] == ids[like + k]).all() for k in range(size)) and (lang[at] == lang[like]).all():
        return at[first], n
    rows = np.column_stack([lang[at], *(ids[at + k] for k in range(size))])
    _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return at[first], n


def _top(scored: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` of each language, ranked; a language is cut to
    ``top`` rows in each of ``salts`` parts first, so none is sorted in one task."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    cut = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in whole numbers of 38 digits."""
    wide = [c.cast("decimal(38,0)") for c in (a, n, l, r)]
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1]).cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, support: int = 100, top: int = 2000, shards: int = 8, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: see the contract of op13."""
    rows = keyed(docs)
    hashes = candidate_hashes(rows, support, shards, longest)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if hashes is None:
        return docs.sparkSession.createDataFrame([], schema)
    counts = written(exact_counts(rows, hashes, longest).where((F.col("n") >= support) | (F.col("words") == 0)), "phrase-counts")
    words = F.split("phrase", " ")
    cand = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    parts = counts.where("words between 1 and 4")
    total = written(counts.where("words = 0").select("lang", F.col("n").alias("n")), "language-words")  # a row a language

    def piece(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))) \
        .select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    cuts = cuts.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: piece(start, size))))
    inside = cand.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    scored = best.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a") \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return _top(scored, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB text of ``collocations`` over ``documents`` with support 100 and 2000 phrases a language.
SQL = r"""
WITH piece AS MATERIALIZED (
  SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f AS MATERIALIZED (
  SELECT lang, k, w[i:i + k - 1] AS ws, count(*) AS n FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
cut AS (
  SELECT c.lang, c.ws, c.n AS a, t.n, l.n AS l, r.n AS r, x.k,
    CAST((CAST(1000 AS HUGEINT) * c.n * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM f c JOIN (SELECT unnest(range(1, 5)) AS k) x ON x.k < c.k
  JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:x.k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[x.k + 1:c.k] JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (
  SELECT lang, ws[i:i + k - 1] AS ws, max(a) AS longer FROM (
    SELECT lang, ws, a, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, n AS a FROM f WHERE f.k > 2), (SELECT unnest(range(2, 5)) AS k)
    WHERE k < len(ws)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN inside USING (lang, ws) WHERE longer IS NULL OR 100 * longer < 100 * a)
QUALIFY rank <= 2000
"""
