"""Language identification in two steps: family first, then the language.

Linear support vector machines, one for each two classes, on hashed byte
trigrams of the whole text. The first step separates language families; the
languages of the chosen family are then told apart by machines trained on
that family alone. Training reads a bounded sample: at most
``sample_per_lang`` rows of each language, by the hash of ``doc_id`` and text;
of rows with the same hash one is used.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text when no row is labelled, unless ``unlearned`` names such
texts with a letter otherwise; a repeated row has a row each; an empty table
gives no rows; of classes with equal votes the first by name is told; very long texts
are read whole. Only ``doc_id``, ``text`` and ``lang`` are read, ``lang`` for
training alone, and the columns named in ``carry``, which come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

DIMS = 4096
#: Families of common languages; another language is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}
#: Letters in lower case, other ASCII as space, further bytes as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the text's hashed byte trigrams, white space runs as one."""
    line = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    b = np.frombuffer(line, np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return np.bincount(code * np.uint32(2654435761) >> np.uint32(20), minlength=DIMS)


def features(texts: list[bytes]) -> np.ndarray:
    x = np.sqrt(np.stack([trigrams(t) for t in texts])).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) by dual coordinate descent, hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    alpha = np.zeros(len(x))
    size = (x * x).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = np.clip(alpha[i] + (1 - y[i] * (x[i] @ w)) / size[i], 0, cost) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


class Pairwise:
    """One machine for each two classes; the class with most soft votes wins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels))
        self.pairs = [(a, b) for i, a in enumerate(self.classes) for b in self.classes[i + 1:]]
        machines = []
        for a, b in self.pairs:
            own = (labels == a) | (labels == b)
            machines.append(_svm(x[own], np.where(labels[own] == a, 1.0, -1.0)))
        self.w = np.stack(machines, axis=1) if machines else np.zeros((x.shape[1] + 1, 0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index and mean vote (0 to 1) of each row."""
        votes = np.zeros((len(x), len(self.classes)))
        margin = x @ self.w[:-1] + self.w[-1]
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(4 * margin[:, k], -30, 30)))
            votes[:, self.classes.index(a)] += p
            votes[:, self.classes.index(b)] += 1 - p
        best = votes.argmax(axis=1)
        return best, votes[np.arange(len(x)), best] / max(1, len(self.classes) - 1) if self.pairs else np.ones(len(x))


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([FAMILY.get(k, k) for k in langs])
        self.family = Pairwise(x, families)
        self.within = {f: Pairwise(x[families == f], langs[families == f]) for f in self.family.classes}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        best, score = self.family.predict(x)
        langs = np.empty(len(x), object)
        for k, f in enumerate(self.family.classes):
            own = np.flatnonzero(best == k)
            if len(own):
                inner, p = self.within[f].predict(x[own])
                langs[own] = np.array(self.within[f].classes, object)[inner]
                score[own] = score[own] * p
        return list(langs), score


def train(labelled: DataFrame, sample_per_lang: int = 500) -> LanguageModel | None:
    """Fits the model on a bounded sample of ``labelled`` (doc_id, text, lang)."""
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    # a share of each language by hash: a little over the bound, cut to it below
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * sample_per_lang / n))])
    picked = labelled.where(chance < shares[F.col("lang")]).select("lang", chance.alias("c"), text_or_empty().alias("text"))
    picked = picked.dropDuplicates(["lang", "c"])  # copies under one id are one row of the sample, however many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            grams = [trigrams(texts[i].encode()) for i in keep]
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())),
                                   pa.array([np.flatnonzero(g).astype("<u2").tobytes() for g in grams], pa.binary()),
                                   pa.array([g[g > 0].astype("<u4").tobytes() for g in grams], pa.binary())],
                                  ["lang", "c", "at", "n"])

    rows, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(picked.mapInArrow(run, "lang string, c double, at binary, n binary").collect(), key=lambda r: (r.c, r.lang, r.at, r.n)):
        if taken[r.lang] < sample_per_lang:
            taken[r.lang] += 1
            rows.append(r)
    if not rows:
        return None
    x = np.zeros((len(rows), DIMS), np.float32)
    for line, r in zip(x, rows):
        line[np.frombuffer(r.at, "<u2")] = np.sqrt(np.frombuffer(r.n, "<u4"))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return LanguageModel(x, np.array([r.lang for r in rows], object))


def predict(docs: DataFrame, model: LanguageModel | None, together: int = 256, carry: tuple[str, ...] = (), unlearned: str = "und") -> DataFrame:
    """doc_id, lang_pred, score, and the columns ``carry``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few machines of DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                texts = part.column(1).to_pylist()
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                if known and not model:
                    for i in known:
                        langs[i] = unlearned
                elif known:
                    found, p = model.predict(features([texts[i].encode() for i in known]))
                    scores[known] = p
                    for i, lang in zip(known, found):
                        langs[i] = lang
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores), *part.columns[2:]],
                                      ["doc_id", "lang_pred", "score", *carry])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry)]
    return docs.select("doc_id", text_or_empty().alias("text"), *carry) \
        .mapInArrow(run, ", ".join([kinds[0], "lang_pred string, score double", *kinds[1:]]))


def held_out(doc_id="doc_id"):
    """Documents that training must not see: crc32 of the id's text divides by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, sample_per_lang: int = 500, carry: tuple[str, ...] = (), unlearned: str = "und") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns ``carry``: trained on
    labelled rows that are not held out, predicted for every row."""
    model = train(docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), sample_per_lang)
    return predict(docs, model, carry=carry, unlearned=unlearned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", *carry)
