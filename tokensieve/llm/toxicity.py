"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

Words are counted in the labelled documents that are not held out, toxic and
clean, under their first three to eight letters and as a whole. The share
of toxic occurrences is smoothed level by level by a Dirichlet prior of
``prior`` occurrences at the share of the level above, from the share
of all words down; a word's score is the log-odds of its share against that of
all words, less ``margin``. One linear scan of a text finds all maximal
scoring segments. Scale and weight of the extreme-value law of segments in
clean text (lambda solves ``E exp(lambda s) = 1`` over clean words, K follows from
the best segments of clean documents) turn segments into E-values: passages
up to ``level`` are significant. A document's segments are aggregated by the
law of the sum of its r best, at the r of least probability, and a logistic curve
over this evidence, fitted on the same documents, gives the score. There each
document is scored with the counts of the other half, halves by a hash of
the text, so copies do not vouch for each other.

Training reads all labelled rows. Counts are combined in tasks; the model is bounded by ``features``
(those with most toxic occurrences stay), and so is what is broadcast.

Defined results: a null or empty text, or one without letters, has no segment
and the lowest score. A document whose label rows differ counts as toxic; null
ids and null labels teach nothing, and a null ``doc_id`` is held out.
Without labelled rows of both kinds every score is 0, or 1 where all are toxic. Repeated rows have
a row each and an empty table gives none; equal scores are equal texts' due.
Very long texts are read whole, ``SLICE`` characters at a time. Only ``doc_id`` and
``text`` of the documents and ``doc_id`` and ``toxic`` of the labels are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

WORD = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6, 7, 8)
SLICE = 1 << 20
#: Different words that a task keeps at a time.
WORDS = 1 << 18
#: Histogram of word scores: bins of a twentieth from -16 to 16.
BINS, STEP = 640, 0.05
#: The largest toxic share that a level hands down as prior mean.
SURE = 0.98
#: Evidence of a text without a segment, and the most that is told apart.
NONE, MOST = -10.0, 200.0


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, a slice at a time, cut outside words."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and WORD.match(text, end):
            end = WORD.match(text, end).end()
        yield WORD.findall(text, at, end)
        at = end


def features_of(words: list[str]) -> np.ndarray:
    """64-bit keys of each word: its stems and itself; 0 where a stem is the whole word or more."""
    digest = xxhash.xxh64_intdigest
    keys = []
    for word in map(str.lower, words):
        keys.extend([digest(word[:n], n) if len(word) > n else 0 for n in STEMS])
        keys.append(digest(word))
    return np.array(keys, np.uint64).reshape(len(words), len(STEMS) + 1)


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    Runs of positive scores are taken in order; a run joins the last segment before it
    that began lower, if it also ends higher, and takes in what lies between.
    """
    up = score > 0
    edge = np.flatnonzero(np.diff(up, prepend=False, append=False))
    if not len(edge):
        return []
    total = np.concatenate([[0.0], np.cumsum(score, dtype=float)])
    kept: list[tuple] = []  # start, end, sum before, sum after, place of the last segment that began lower
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        low, high = total[start], total[end]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((start, end, low, high, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(s, e, float(high - low)) for s, e, low, high, _ in kept]


@dataclass
class Model:
    keys: np.ndarray  # sorted feature keys
    toxic: np.ndarray  # occurrences of each in toxic documents of the two halves
    clean: np.ndarray
    share: np.ndarray  # toxic share of all words, by half
    prior: float
    margin: float
    scale: float = 1.0  # lambda
    weight: float = 0.0  # ln K
    slope: float = 1.0
    shift: float = 0.0
    level: float = 0.05
    constant: float | None = None
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def counts(self, half: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Toxic and clean occurrences of each feature and the toxic share of all words, of both halves or the other one."""
        use = [0, 1] if half is None else [1 - half]
        return self.toxic[:, use].sum(axis=1), self.clean[:, use].sum(axis=1), self.share[use].mean()

    def word_scores(self, words: list[str], half: int | None = None) -> np.ndarray:
        """Scores by the counts of both halves, or by those of the other half only."""
        if half not in self.known:
            self.known[half] = ({}, *self.counts(half))
        known, toxic, clean, base = self.known[half]
        if len(known) > WORDS:
            known.clear()
        new = list(set(words).difference(known))
        if new:
            rows = features_of(new)
            p, q = np.full(len(new), base), np.full(len(new), 1 - base)
            at = np.minimum(np.searchsorted(self.keys, rows), max(0, len(self.keys) - 1))
            hits = (self.keys[at] == rows) & (rows > 0) if len(self.keys) else np.zeros(rows.shape, bool)
            for j in np.flatnonzero(hits.any(axis=0)):
                hit = hits[:, j]
                t, c = toxic[at[hit, j]], clean[at[hit, j]]
                # a prior is never surer than SURE, so that stems do not vouch for each other without end
                mean = np.clip(p[hit] / (p[hit] + q[hit]), 1 - SURE, SURE)
                p[hit], q[hit] = t + self.prior * mean, c + self.prior * (1 - mean)
            odds = np.log(p / q) - np.log(base / (1 - base)) - self.margin
            known.update(zip(new, odds.tolist()))
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def text_scores(self, text: str, half: int | None = None) -> np.ndarray:
        return np.concatenate([np.empty(0), *(self.word_scores(w, half) for w in words_of(text))])

    def evidence(self, scores: np.ndarray, n: int) -> float:
        """-ln of the least probability of the r best segments in clean text of n words."""
        if not len(scores):
            return NONE
        normal = np.cumsum(self.scale * np.sort(scores)[::-1] - self.weight - np.log(n))
        r = np.arange(1, len(normal) + 1)
        high = normal > 1
        lg = np.cumsum(np.log(r))  # ln r!
        many = normal - (r - 1) * np.log(np.maximum(normal, 1)) + lg + lg - np.log(r)
        return float(np.clip(max(normal[0], (many[high]).max(initial=NONE)), NONE, MOST))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


def held_out(doc_id="doc_id"):
    """Documents whose labels training must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half) of the documents that teach."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()) \
        .groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    own = docs.where(~held_out()).select(F.col("doc_id"), text_or_empty().alias("text"))
    # labels grow with the documents: both sides are shuffled at every size
    rows = own.join(known.hint("merge"), F.col("doc_id") == F.col("_id"))
    return written(rows.select("text", F.col("_toxic").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "toxicity-train")


def _counted(rows: DataFrame, keys=None) -> DataFrame:
    """(key, n0, n1): occurrences by half, of all features or those in the broadcast ``keys``.
    The row of key 0 counts all words."""

    def flush(words: Counter):
        names = list({w for w, _ in words})
        at = {w: i for i, w in enumerate(names)}
        n = np.zeros((len(names), 2), np.int64)
        for (w, half), count in words.items():
            n[at[w], half] += count
        rows = features_of(names)
        key, n = rows.ravel(), np.repeat(n, rows.shape[1], axis=0)
        use = key > 0
        if keys is not None:
            place = np.minimum(np.searchsorted(keys.value, key), len(keys.value) - 1)
            use &= keys.value[place] == key
        key, group = np.unique(key[use], return_inverse=True)
        total = np.stack([np.bincount(group, weights=n[use, h], minlength=len(key)) for h in (0, 1)], axis=1).astype(np.int64)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["key", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        total = [0, 0]
        for batch in batches:
            for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in words_of(text):
                    words.update((w.lower(), half) for w in part)
                    total[half] += len(part)
                    if len(words) > WORDS:
                        yield flush(words)
                        words.clear()
        if words:
            yield flush(words)
        yield pa.record_batch([pa.array([0]), pa.array(total[:1]), pa.array(total[1:])], ["key", "n0", "n1"])

    parts = rows.select("text", "half").mapInArrow(run, "key long, n0 long, n1 long")
    return parts.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _numbers(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, their counts by half, and the counts of all words."""
    table = counts.toArrow()
    key = table.column("key").to_numpy().view(np.uint64)
    n = np.stack([table.column("n0").to_numpy(), table.column("n1").to_numpy()], axis=1)
    order = np.argsort(key)
    key, n = key[order], n[order]
    return key[1:], n[1:], n[0]


def lexicon(train: DataFrame, prior: float, margin: float, features: int, least: int) -> Model | None:
    """Counts of the features that occur ``least`` times in toxic documents."""
    kinds = {r[0] for r in train.select("toxic").distinct().collect()}
    if kinds != {0, 1}:
        return None
    counts = written(_counted(train.where("toxic = 1")).where(F.expr(f"key = 0 or n0 + n1 >= {least}")), "toxic-words")
    held = counts.count()
    if held > features:
        cut = counts.where("key != 0").agg(F.percentile_approx(F.expr("n0 + n1"), 1 - features / held, 10_000)).first()[0]
        counts = counts.where(F.expr(f"key = 0 or n0 + n1 > {cut}"))
    key, toxic, toxic_words = _numbers(counts)
    if not len(key) or not toxic_words.sum():
        return None
    shared = train.sparkSession.sparkContext.broadcast(key)  # 8 bytes a feature
    found, n, clean_words = _numbers(_counted(train.where("toxic = 0"), shared))
    clean = np.zeros_like(toxic)
    clean[np.searchsorted(key, found)] = n
    share = (toxic_words + 1) / (toxic_words + clean_words + 2)
    return Model(key, toxic, clean, share, prior, margin)


def _extremes(train: DataFrame, model: Model) -> DataFrame:
    """Of each teaching document the segments found by the other half's counts
    (toxic, n, segments), and a histogram of the words' scores in clean ones (bin, n)."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS, np.int64)
        for batch in batches:
            rows = []
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
                score = shared.value.text_scores(text, half)
                rows.append((None, len(score), toxic, [s for *_, s in maximal_segments(score)]))
                if not toxic:
                    bins += np.bincount(np.clip((score / STEP + BINS / 2).round().astype(int), 0, BINS - 1), minlength=BINS)
            if rows:
                yield _rows(rows)
        yield _rows([(b, int(n), None, None) for b, n in enumerate(bins) if n] or [(None, 0, None, None)])

    def _rows(rows):
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bin", "n", "toxic", "segments"])

    return written(train.select("text", "toxic", "half").mapInArrow(run, "bin int, n long, toxic int, segments array<double>"), "toxicity-extremes")


def solve_scale(score: np.ndarray, count: np.ndarray) -> float:
    """The positive lambda with mean exp(lambda * score) = 1; 1 where there is none."""
    if not (score > 0).any() or (score * count).sum() >= 0:
        return 1.0
    low, high = 0.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.exp(mid * score) * count).sum() < count.sum() else (low, mid)
    return low


def logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve over binned evidence, by Newton steps with smoothed targets."""
    pos, neg = toxic.sum(), clean.sum()
    n, y = toxic + clean, (toxic * (pos + 1) / (pos + 2) + clean / (neg + 2)) / np.maximum(toxic + clean, 1)
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([0.1, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (y - p)) - 1e-3 * w
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        w = w + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    return max(float(w[0]), 1e-3), float(w[1])


def train(docs: DataFrame, labels: DataFrame, prior: float = 10.0, margin: float = 2.5, features: int = 1 << 20,
          least: int = 2, level: float = 0.05) -> Model:
    rows = labelled(docs, labels)
    model = lexicon(rows, prior, margin, features, least)
    if model is None:
        share = rows.agg(F.avg("toxic")).first()[0]
        return Model(np.empty(0, np.uint64), np.zeros((0, 2)), np.zeros((0, 2)), np.array([.5, .5]), prior, margin,
                     constant=1.0 if share == 1 else 0.0, level=level)
    model.level = level
    seen = _extremes(rows, model)
    bins = seen.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS rows at most
    model.scale = solve_scale(np.array([(r.bin - BINS / 2) * STEP for r in bins]), np.array([r.n for r in bins], float))
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    mean = seen.where("toxic = 0 and n > 0").agg(F.avg(F.col("n") * F.exp(F.lit(-model.scale) * best))).first()[0]
    model.weight = -float(np.log(mean)) if mean else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [round(4 * model.evidence(np.array(s or []), n)) for n, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int32())], ["toxic", "at"])

    at = seen.where("toxic is not null").select("toxic", "n", "segments").mapInArrow(run, "toxic int, at int")
    counted = at.groupBy("at").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()  # (MOST - NONE) * 4 rows at most
    model.slope, model.shift = logistic(np.array([r["at"] / 4 for r in counted]), np.array([r["t"] for r in counted], float),
                                        np.array([r["c"] for r in counted], float))
    return model


def spans(text: str, found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Characters from the first to the last word of each segment, in text order."""
    out, want = [], iter(found)
    start, end, _ = next(want)
    for i, m in enumerate(WORD.finditer(text)):
        if i == start:
            first = m.start()
        if i == end - 1:
            out.append((first, m.end()))
            start, end, _ = next(want, (-1, -1, 0))
            if start < 0:
                break
    return out


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant ``passages`` (start, end, score, evalue) of every text, in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            evidence, rows = [], []
            for text in batch.column(1).to_pylist():
                score = model.text_scores(text)
                found = maximal_segments(score)
                evidence.append(model.evidence(np.array([s for *_, s in found]), len(score)))
                value = [float(np.exp(np.clip(model.weight + np.log(len(score)) - model.scale * s, -700, 700))) for *_, s in found]
                good = [(f, v) for f, v in zip(found, value) if v <= model.level]
                where = spans(text, [f for f, _ in good]) if good else []
                rows.append([{"start": a, "end": b, "score": f[2], "evalue": v} for (a, b), (f, v) in zip(where, good)])
            yield pa.record_batch([batch.column(0), pa.array(model.score(np.array(evidence))), pa.array(rows, kind)], ["doc_id", "score", "passages"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, "
             "passages array<struct<start: bigint, end: bigint, score: double, evalue: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, least_score: float = 0.7, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least ``least_score``) and passages of every document."""
    return passages(docs, train(docs, labels, **settings)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least_score).cast("int").alias("predicted"), "passages")
