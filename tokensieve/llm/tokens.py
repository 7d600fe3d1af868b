"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

No vocabulary entry of the supported files holds a space or a line feed, so a
text's ids are the ids of its parts between those two characters, in order
(``tests/llm`` compares with whole-text encoding). The parts of some texts are
made a dictionary, so that each different one is looked up once, and Numpy
puts the ids in the texts' order. Each task worker keeps the ids it has met,
up to a bound, and asks the library only for new ones.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Entries of a worker's store; those not used of late go first.
KEPT_PARTS = 500_000
#: Longer parts are asked anew each time.
KEPT_PART_CHARS = 48
#: Bytes of text whose parts are looked up together; parts put in order
#: together; ids given together.
TEXT_BYTES = 16 << 20
ORDERED_PARTS = 1 << 15
CODED_IDS = 1 << 16
#: Punctuation that may follow the letters of a part.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: A vocabulary file is read on the driver and broadcast; larger ones are refused.
MAX_VOCAB_BYTES = 64 << 20

_open: dict[int, "PartEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for a byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that have ``most`` together, or a little more."""
    ends, first, before = np.cumsum(sizes), 0, 0
    while first < len(ends):
        upto = min(int(np.searchsorted(ends, before + most)) + 1, len(ends))
        yield first, upto
        first, before = upto, ends[upto - 1]


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Kept:
    """Key -> its ids as little-endian unsigned 32-bit integers, asked for once
    while the key is in use: entries that were not used while half of the
    store was filled anew are dropped."""

    def __init__(self, ask: Callable[[str], bytes]):
        self.ask, self.newer, self.older = ask, {}, {}

    def find(self, keys: list[str]) -> list[bytes]:
        # step by step over all keys: the library and the store each use the processor's cache in turn
        found = list(map(self.newer.get, keys))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, list(map(self.older.get, [keys[k] for k in new]))):
            found[k] = ids
        for k in [k for k in new if found[k] is None]:
            found[k] = self.ask(keys[k])
        if len(self.newer) + len(new) > KEPT_PARTS // 2:
            self.older, self.newer = self.newer, {}
        self.newer.update((keys[k], found[k]) for k in new[:KEPT_PARTS // 2] if len(keys[k]) <= KEPT_PART_CHARS)
        return found


class PartEncoder:
    """Texts -> their ids.

    A part that is letters and then ASCII punctuation splits there under
    the file's own rules, so its two runs go straight to the library's model;
    any other part goes through the library's whole encoding.
    """

    def __init__(self, vocab_json: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.loads(vocab_json)
        self.whole = Tokenizer.from_str(vocab_json)
        self.model = self.whole.model
        self.simple = (spec["model"].get("end_of_word_suffix") == "</w>"
                       and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
                       == ["NFC", "Replace", "Lowercase"])
        self.letters = _byte_letters()
        self.words, self.marks, self.parts = Kept(self._word), Kept(self._run), Kept(self._whole)

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(run)]
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """None at all for a word that the file's rules may change or cut."""
        low = word.lower()
        if low.isalpha() and (low.isascii() or "Σ" not in word and unicodedata.is_normalized("NFC", word)):
            return self._run(low)
        return b""

    def _whole(self, part: str) -> bytes:
        ids = self.whole.encode(part, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _lowered(self, text: str) -> str:
        # lower case first makes fewer kinds of parts, where it changes no id:
        # special tokens are matched in the raw text, and sigma depends on its place
        if self.simple and "<|" not in text and "Σ" not in text and unicodedata.is_normalized("NFC", text):
            text = text.lower()
        return text.replace("\n", " ")

    def _split(self, parts: pa.LargeStringArray) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Each part's letters, or whatever stands before the punctuation at
        its end, and that punctuation; ``parts`` is no slice."""
        words = pc.ascii_rtrim(parts, characters=MARKS)
        size = pc.binary_length(words).to_numpy()
        ends = np.cumsum(pc.binary_length(parts).to_numpy())
        rest = ends - np.append(0, ends[:-1]) - size
        data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
        marks = pa.LargeStringArray.from_buffers(
            len(parts), pa.py_buffer(np.append(0, np.cumsum(rest))), pa.py_buffer(data[_places(ends - rest, rest)]))
        return words.dictionary_encode(), marks.dictionary_encode()

    def _ids_of(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts, one after the other, and how many each has."""
        whole = np.arange(len(parts))
        pool, runs = [b""], np.zeros((len(parts), 2), np.int64)
        if self.simple:
            words, marks = self._split(parts)
            found = self.words.find(_strings(words.dictionary))
            word, mark = words.indices.to_numpy(), marks.indices.to_numpy()
            known = np.fromiter(map(len, found), np.int64, len(found))[word] > 0
            used = np.unique(mark[known])
            place = np.zeros(len(marks.dictionary), np.int64)
            place[used] = 1 + len(found) + np.arange(len(used))
            pool += found + self.marks.find(_strings(marks.dictionary.take(pa.array(used))))
            runs[known] = np.stack([1 + word[known], place[mark[known]]], axis=1)
            whole = np.flatnonzero(~known)
        runs[whole, 0] = len(pool) + np.arange(len(whole))
        pool += self.parts.find(_strings(parts.take(pa.array(whole))))
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        first = np.cumsum(size) - size
        both = runs.ravel()
        return np.frombuffer(b"".join(pool), "<u4")[_places(first[both], size[both])], size[runs].sum(axis=1)

    def encode_all(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The texts in runs of about ``CODED_IDS`` ids: the place of the
        first, the ids (uint32) of each ended by ``end_id``, one after the
        other, and how many each has."""
        split = pc.split_pattern(pa.array([self._lowered(t.as_py()) for t in texts], pa.large_string()), " ")
        parts, bounds = split.values.dictionary_encode(), split.offsets.to_numpy()
        del split
        ids, size = self._ids_of(parts.dictionary)
        ids, size = np.append(ids, np.uint32(end_id)), np.append(size, 1)
        first = np.cumsum(size) - size
        which = parts.indices.to_numpy()
        del parts
        before = np.concatenate(([0], np.cumsum(size[which], dtype=np.int64)))[bounds]
        lengths = np.diff(before) + 1
        for a, b in groups(lengths, CODED_IDS):
            order = np.insert(which[bounds[a]:bounds[b]], bounds[a + 1:b + 1] - bounds[a], len(size) - 1)
            runs = [ids[_places(first[some], size[some])] for some in np.split(order, range(ORDERED_PARTS, len(order), ORDERED_PARTS))]
            yield a, np.concatenate(runs), lengths[a:b]

    def encode(self, text: str) -> bytes:
        return b"".join(ids.tobytes() for _, ids, _ in self.encode_all(pa.array([text]), 0))[:-4]

    def chunks(self, rows: pa.Array, texts: pa.Array, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """``encode_all`` of ``TEXT_BYTES`` of texts at a time, with the ``rows`` of each run."""
        for first, upto in groups(pc.binary_length(texts).to_numpy(zero_copy_only=False), TEXT_BYTES):
            for at, ids, lengths in self.encode_all(texts.slice(first, upto - first), end_id):
                yield rows.slice(first + at, len(lengths)), ids, lengths


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def encoder(vocab) -> PartEncoder:
    """The worker's encoder for a broadcast vocabulary."""
    key = hash(vocab.value)
    if key not in _open:
        _open.clear()
        _open[key] = PartEncoder(vocab.value)
    return _open[key]


def shared_vocab(spark: SparkSession, path: str):
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def default_vocab() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
