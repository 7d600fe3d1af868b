"""Each training-data operator against a brute-force version, and the cases
that its docstring defines."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tokensieve.llm import chat_format, decontaminate, html_extract, langid, line_dedup, packing, queries, simhash_dedup, simple8b, tokens
from tokensieve.llm.components import components
from tokensieve.llm.embed_dedup import near_vectors
from tokensieve.llm.suffix_dedup import remove_repeats

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, node long, _h long, doc long"
LONG = "Word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns that clash."""
    rows = [(1, "a b c d e f\nsecond line\nthird", "en"), (1, "a b c d e f\nsecond line\nthird", "en"), (2, None, "en"), (3, "", None),
            (None, "a b c d e f", "fr"), (4, LONG, "en"), (5, "12 + 3", "de"), (1, "other text", "en"), (6, "ça va bien, où ?", "fr"), (7, LONG, None)]
    return spark.createDataFrame([(a, b, c, None, 7, 8, 9, 10) for a, b, c in rows], DOC)


def ids_of(text):
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text, add_special_tokens=False).ids


def top(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def classes(links):
    parent = {}
    for a, b in links:
        x, y = top(parent, a), top(parent, b)
        parent[max(x, y)] = min(x, y)
    return {x: top(parent, x) for x in list(parent)}


def test_parts_encode_as_whole_texts():
    e = tokens.PartEncoder(open(tokens.default_vocab()).read())
    texts = ["a\x1cb \x85 c d", "Σας ΟΔΟΣ Σ", "<|endoftext|>x <|startoftext|> X<|ENDOFTEXT|>", " ̈a é", "it's 's we'll 12ab don't' a'\n\n x",
             "Åİ İstanbul", "", " ", "ﬁ ½ ²", "the,*** a. B! x<|", "é. ñ.. 漢字。 ÀÉ,", "étude É"]
    texts += pd.read_parquet(f"{SMALL}/documents.parquet").text.tolist()
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, t


def test_each_word_is_asked_once_whatever_stands_after_it(monkeypatch):
    """The library gets a word once for all punctuation that follows it, and words in use stay kept when the store is full."""
    monkeypatch.setattr(tokens, "KEPT_PARTS", 200)

    class Asked:
        def __init__(self, model):
            self.model, self.runs = model, []

        def tokenize(self, run):
            self.runs.append(run)
            return self.model.tokenize(run)

    e = tokens.PartEncoder(open(tokens.default_vocab()).read())
    e.model = Asked(e.model)
    name = ["".join(x) for x in itertools.product("bdfg", "aeiou", "klmn", "rst")][:210]
    texts = [" ".join(w + m for w in name[k:k + 30] for m in (",", ".", "###", "", "?!")) + " hot" for k in range(0, 210, 30)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(t)
    asked = [r for r in e.model.runs if r.isalpha()]
    assert len(asked) == len(set(asked)) == 211


def test_encoding_in_runs(monkeypatch):
    """Rows, ids and lengths stay together over chunks and runs of any size."""
    texts = ["", "a b, c.", "don't x\ty", " ", "word " * 300, "Σας, é.. 漢字。", "<|endoftext|>, ABC", "---", "b,\n\nb."] * 3
    want = [ids_of(t) + [2] for t in texts]
    for chunk, run, part in ((1, 1, 1), (40, 7, 2), (1 << 20, 1 << 10, 1 << 15)):
        monkeypatch.setattr(tokens, "TEXT_BYTES", chunk)
        monkeypatch.setattr(tokens, "CODED_IDS", run)
        monkeypatch.setattr(tokens, "ORDERED_PARTS", part)
        e = tokens.PartEncoder(open(tokens.default_vocab()).read())
        got = [(r.to_pylist(), np.split(ids, np.cumsum(n)[:-1])) for r, ids, n in e.chunks(pa.array(range(len(texts))), pa.array(texts), 2)]
        assert [d for rows, _ in got for d in rows] == list(range(len(texts)))
        assert [x.tolist() for _, docs in got for x in docs] == want
        assert list(e.chunks(pa.array([], pa.int64()), pa.array([], pa.string()), 2)) == []


def test_simple8b_round_trip():
    r = random.Random(1)
    for _ in range(200):
        high = r.choice([2, 16, 300, 50_000, 2**31, 2**59, 2**64])
        docs = [np.array([r.randrange(r.choice([1, 2, high])) for _ in range(r.choice([0, 1, 2, 5, 300]))], np.uint64) for _ in range(3)]
        lengths = np.array([len(d) for d in docs])
        words, sizes = simple8b.encode_ids(np.concatenate(docs), lengths)
        assert sizes.sum() == len(words)
        if lengths.sum():
            assert (simple8b.decode_words(words, np.cumsum(sizes) - sizes, lengths) == np.concatenate(docs)).all()


def test_words_take_as_many_ids_as_any_selector_allows():
    """Word by word from the rule, also at document ends and for escapes; few steps a word."""
    r = np.random.default_rng(8)
    for t in range(60):
        lengths = r.integers(0, int(r.choice([3, 90])), int(r.integers(1, 6)))
        ids = (2.0 ** (r.random(int(lengths.sum())) * r.choice([2, 9, 16, 62]))).astype(np.uint64)
        ids = np.where(r.random(len(ids)) < (t % 3) / 2, ids % np.uint64(4), ids)
        want, sizes, p = [], [], 0
        for length in lengths:
            before, end = len(want), p + int(length)
            while p < end:
                for k, bits in enumerate(simple8b.BITS[:-1]):
                    run = ids[p:min(p + 60 // bits, end)].tolist()
                    if max(run) < 1 << bits:
                        want.append(sum(v << (j * bits) for j, v in enumerate(run)) | (k + 1) << 60)
                        break
                else:
                    run = ids[p:p + 1].tolist()
                    want += [0, *run]
                p += len(run)
            sizes.append(len(want) - before)
        words, taken = simple8b.encode_ids(ids, lengths)
        assert words.tolist() == want and taken.tolist() == sizes
        assert simple8b.decode_words(words, np.cumsum([0, *sizes])[:-1], lengths).tolist() == ids.tolist()


def test_token_files(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        out = sorted(simple8b.token_files(docs).collect(), key=lambda r: r.start)
        want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array(ids_of(r.text or "") + [2], "<u4").tobytes())) for r in docs.collect())
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in out) == want
        assert [r.start for r in out] == list(itertools.accumulate((r.n_tokens for r in out), initial=0))[:-1]
        ids = [-1 if r.doc_id is None else r.doc_id for r in out]
        assert ids == sorted(ids)
    assert simple8b.token_files(odd.limit(0)).count() == 0


def test_token_files_of_many_parts(spark, monkeypatch, tmp_path):
    """Ids in ascending order over the parts, null ids first; one Python step codes and tells the part."""
    monkeypatch.setattr(simple8b, "TASK_BYTES", 500)
    rows = [(None if k % 50 == 3 else (k * 37) % 211 - 90, f"word{k} and, more. " * (k % 5)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    simple8b.write_token_files(docs, str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).select("part").distinct().count() > 5
    out = sorted(simple8b.read_token_files(spark, str(tmp_path / "files")).collect(), key=lambda r: r.start)
    low = lambda d: -10**6 if d is None else d
    assert [low(r.doc_id) for r in out] == sorted(low(d) for d, _ in rows)
    assert [r.start for r in out] == list(itertools.accumulate((r.n_tokens for r in out), initial=0))[:-1]
    assert sorted((low(r.doc_id), r.ids_crc32) for r in out) == sorted((low(d), zlib.crc32(np.array(ids_of(t) + [2], "<u4").tobytes())) for d, t in rows)
    coded = simple8b.coded_documents(docs, tokens.default_vocab(), 2, np.array([0, 50]))
    assert {low(r.doc_id): r._part for r in coded.collect()} == {low(d): 0 if d is None or d < 0 else 1 if d < 50 else 2 for d, _ in rows}


def test_packing(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        got = packing.pack_documents(docs, capacity=512).toPandas()
        want = sorted(zlib.crc32(np.array(ids[at:at + 512], "<u4").tobytes()) for ids in (ids_of(r.text or "") + [1] for r in docs.collect())
                      for at in range(0, len(ids), 512))
        assert sorted(got.ids_crc32) == want
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 512
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) * 1.05 + 1
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_plan_uses_every_length():
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randrange(1, 101): r.randrange(1, 9) for _ in range(r.randrange(1, 40))}
        used = {}
        for times, parts in packing.plan_bins(counts, 100):
            assert sum(k * n for k, n in parts) <= 100
            for k, n in parts:
                used[k] = used.get(k, 0) + n * times
        assert used == counts
    assert packing._fullest({60: 1, 50: 2, 7: 3}, [60, 50, 7], 100) == [(50, 2)]


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in classes([p for p in links if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = [(r.doc_id, plain_simhash(r.text or "")) for r in docs.collect()]
        label = classes([(i, j) for i in range(len(rows)) for j in range(i + 1) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4])
        first = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                first[label[i]] = min(first.get(label[i], d), d)
        want = sorted((str(d), f"{f:016x}", first.get(label[i])) for i, (d, f) in enumerate(rows))
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect())
        assert got == want
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_fingerprint_links_find_every_pair(spark):
    r = random.Random(6)
    fps = [r.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for f in fps for _ in range(4)]
    fps = sorted({simhash_dedup._signed(f) for f in fps})
    got = sorted((x.a, x.b) for x in simhash_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect())
    assert got == [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]


def test_keys_of_fingerprints_are_not_broadcast(spark):
    """Spark takes 64 keys a fingerprint for one row, and would send those of few fingerprints over the driver."""
    fps = spark.range(2000).select(F.xxhash64(F.col("id") % 1000).alias("fp"))
    links = simhash_dedup.fingerprint_links(fps.distinct())
    before = links._jdf.queryExecution().executedPlan().toString()
    links.collect()
    for plan in (before, links._jdf.queryExecution().executedPlan().toString()):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_does_not_broadcast_the_keys_of_its_texts(spark, monkeypatch):
    import corpus_pipeline
    links, plans = simhash_dedup.fingerprint_links, []

    def seen(fps, max_distance):
        out = links(fps, max_distance)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash_dedup, "fingerprint_links", seen)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5(F.concat((F.col("id") % 40).cast("string"), F.lit(str(k)))) for k in range(8)]).alias("text"))
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SMALL).collect()) == list(range(40))
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def plain_repeats(rows, length):
    seen = {}
    for _, t in rows:
        for s in range(len(t) - length + 1):
            seen[t[s:s + length]] = seen.get(t[s:s + length], 0) + 1
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if seen[t[s:s + length]] > 1:
                gone[s:s + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append((str(d), len(t), tuple(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return sorted(out)


@pytest.mark.parametrize("together", [500, 2])
def test_suffix_dedup(spark, odd, together):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé \n") for _ in range(700)) for _ in range(3)]
    rows = [(i, "ab" * r.randrange(200)) for i in range(8)]
    for i in range(8, 40):
        t = list(r.choice(base)[r.randrange(300):])
        t[r.randrange(len(t))] = "#"
        rows.append((i, "".join(t) + "z" * r.randrange(3)))
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd.withColumn("text", F.substring("text", 1, 3000))):
        got = sorted((str(x.doc_id), x.n_bytes, tuple((s.start, s.end) for s in x.spans), bytes(x.kept)) for x in remove_repeats(docs, 60, 20, together).collect())
        assert got == plain_repeats([(x.doc_id, (x.text or "").encode()) for x in docs.collect()], 60)
    assert remove_repeats(odd.limit(0)).count() == 0


def test_line_dedup(spark, odd):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, None), (9, "a\nb\nc\nd"), (3, ""), (1, "q\nr\nc\nd"), (4, "z\na\nb\nc\nd\n")]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, removed_lines int, k string")
    chunks = {(r.doc_id, r.text): [tuple(c) for c in r[-1]] for r in line_dedup.with_chunks(docs.where("text is not null"), 2).collect()}
    seen, want = {}, []
    for key in sorted(chunks):
        for k, n, t in chunks[key]:
            if n > 1:
                seen.setdefault(t, key)
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    first = {t: min((key[0], hashed[key[1]], k) for key in chunks for k, n, u in chunks[key] if u == t) for t in seen}
    for d, t in rows:
        own = chunks.get((d, t), [])
        kept = [u for k, n, u in own if n < 2 or first[u] == (d, hashed[t], k)]
        want.append((d, "\n".join(kept) if t is not None else None))
    got = line_dedup.dedup_lines(docs, 2)
    assert got.columns == ["doc_id", "text", "removed_lines", "k", "_ts_line_removed_lines", "removed_chunks"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_decontamination(spark, odd):
    r = random.Random(3)
    bench = [(k, "".join(r.choice("abcde fgh") for _ in range(r.randrange(60, 140)))) for k in range(4)]
    docs = []
    for i in range(60):
        x = "".join(r.choice("abcde fgh") for _ in range(r.randrange(200)))
        t = list(r.choice(bench)[1])
        for _ in range(r.randrange(11)):
            p = r.randrange(len(t))
            t[p:p + r.randrange(2)] = r.choice(["", "a", "h"])
        docs.append((i, x + "".join(t).upper() + x[::-1] if r.random() < 0.8 else x))
    items = spark.createDataFrame(bench + [(8, None), (9, "short")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    want = {}
    for (d, t), (k, b) in itertools.product(docs, bench):
        n = plain_distance(b, t.lower())
        if n <= decontaminate.budget(len(b), 0.06, 12):
            want[d, k] = n
    assert got == want and want
    assert decontaminate.leaks(odd, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.leaks(odd.limit(0), items).count() == 0


def test_language_id(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for h, d in zip(out.held_out, out.doc_id))
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).collect()}
    assert {(d, s) for d, p, s in got if p == "und"} == {(2, 0.0), (3, 0.0), (5, 0.0)}
    assert all(p == "und" for _, p, _ in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("doc_id", "lang_pred", "score").collect())
    assert langid.identify(odd.limit(0)).count() == 0


def plain_vectors(rows):
    sound = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, i) for i in range(len(rows))]
    degree = [0] * len(rows)
    for i, j in itertools.combinations(sound, 2):
        a, b = (np.array(rows[k][1], float) for k in (i, j))
        if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links.append((i, j))
            degree[i] += 1
            degree[j] += 1
    label = classes(links)
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(least.get(label[i], r[0]), r[0])
    return sorted((r[0], degree[i], least[label[i]], r[0] == least[label[i]]) for i, r in enumerate(rows))


def test_near_vectors(spark):
    odd = [(1, [1., 2.], 1), (2, [1., 2.], 1), (2, [1., 2.], 1), (3, [2., 4.], 1), (4, None, 1), (5, [0., 0.], 1), (6, [1., None], 1), (7, [float("nan"), 1.], 1),
           (8, [1., 2.], None), (9, [], 1), (10, [1., 2., 3.], 1), (11, [-1., 0.], 1), (12, [1., 2.], 2), (13, [float("inf"), 1.], 1)]
    table = spark.createDataFrame([(*r, 1, 2) for r in odd], "vec_id long, embedding array<float>, label int, node long, n_links long")
    assert sorted(map(tuple, near_vectors(table).collect())) == plain_vectors(odd)
    assert near_vectors(table.limit(0)).count() == 0
    data = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert sorted(map(tuple, near_vectors(data, block=7).collect())) == plain_vectors([(r.vec_id, r.embedding, r.label) for r in data.collect()])


def test_minimum_cut():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 8)
        source, sink = ([r.randrange(10) for _ in range(n)] for _ in range(2))
        edges = [(a, b, r.randrange(1, 6)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda x: sum(sink[i] if x[i] else source[i] for i in range(n)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(html_extract.minimum_cut(source, sink, edges)) == min(map(cost, itertools.product([0, 1], repeat=n)))


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>Home</a></nav><div class="cookie-notice">We use cookies.</div>
      <article><h1>Head &amp; line</h1><p>First <b>bold<br>text.<p>Second&nbsp; one &#x41;.</p><script>var t="</p>";</script><form><input>Mail</form><p>Go.</p>
      <section class="comments"><p>Nice article, thanks a lot for writing it.</p></section></article>
      <aside><p>Related reading and other long text that is not the article.</p></aside><footer>&copy; x</footer></body></html>"""
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 5000 + "deep"), (5, "w", "a < b <unclosed")]
    pages = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[1].text == "Head & line\nFirst bold text.\nSecond one A.\nGo." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and html_extract.extract(pages).count() == 6
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [("t", 1, None, 1., "user", "q"), ("t", 2, 1, 1., "assistant", "a<|im_end|>"), ("t", 3, 1, 5., "assistant", "b\\|<\\|x<<|"),
            ("t", 4, 3, 1., "us\ner\\n<|", "c"), ("t", 5, 2, 9., "assistant", None), ("u", 1, 2, 0., "a", "x"), ("u", 2, 1, 0., "a", "x"), ("v", 9, 77, 1., None, "<|")]
    trees = spark.createDataFrame([(*r, 1) for r in rows], "tree string, id long, parent long, score double, role string, text string, depth int")
    out = chat_format.format_trees(trees, top=2).withColumn("turns", chat_format.read_turns(F.col("formatted"))) \
        .withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {(r.tree, r.path_rank): ([tuple(t) for t in r.turns], r.loss) for r in out}
    assert got == {("t", 1): ([("user", "q"), ("assistant", "a<|im_end|>"), ("assistant", "")], "a<|im_end|>"),
                   ("t", 2): ([("user", "q"), ("assistant", "b\\|<\\|x<<|"), ("us\ner\\n<|", "c")], "b\\|<\\|x<<|"), ("v", 1): ([("", "<|")], "")}
    talk = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 0, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.with_control(talk)).collect()}
    assert got[1].n_turns == 2 and got[None].n_turns == 1 and got[2].loss_chars == len(LONG)
    assert got[-1].loss_sha256 == hashlib.sha256(chat_format.CONTROL.encode()).hexdigest()
    assert chat_format.digests(talk.limit(0)).count() == 0


def test_sql_twins(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        same = [x[cols].sort_values(cols[0] if cols[0] == "conv_id" else [c for c in cols if c.endswith("_id")] or cols).reset_index(drop=True) for x in (got, want)]
        pd.testing.assert_frame_equal(*same, check_dtype=False, obj=name)


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        kept = out.toPandas()
        if name == "language_id":
            assert set(kept.doc_id) == {d for d, t in zip(rows.doc_id, rows.text) if any(map(str.isalpha, t or ""))}
        if name == "simhash_near_dedup":
            fps = [plain_simhash(t) for t in rows.text]
            label = classes([(i, j) for i in range(len(fps)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 4])
            assert set(kept.doc_id) == {min(d for k, d in enumerate(rows.doc_id) if label[k] == c) for c in set(label.values())}
        if name == "benchmark_decontamination":
            bench = pd.read_parquet(f"{SMALL}/benchmark.parquet").text
            assert not any(b in t for b in bench for t in kept.text) and len(kept) >= sum(not any(b[:30] in t for b in bench) for t in rows.text)


def test_pipeline_tells_rows_of_an_id_apart(spark, odd, tmp_path):
    import corpus_pipeline
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    item = "The benchmark asks which of the seven rivers flows north in winter."
    near = " ".join(f"word{i}" for i in range(200))
    more = spark.createDataFrame([(None, "12 + 3", "en"), (None, "g h i j", "fr"), (1, "== 4", "en"), (1, f"x {item} y", "en"), (None, item, "en"), (0, near, "en"),
                                  (1, near, "en"), (None, near, "en"), (None, "alone here", "en"), (None, "alone here too, twice", "en")], "doc_id long, text string, lang string")
    docs = odd.select("doc_id", "text", "lang").unionByName(more)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    all_rows = rows(docs.where("text is not null"))
    assert rows(stages["language_id"](spark, docs, str(tmp_path))) == [r for r in all_rows if any(map(str.isalpha, r[1]))]
    kept = stages["benchmark_decontamination"](spark, docs.where("text is not null"), str(tmp_path))
    assert rows(kept) == [r for r in all_rows if item not in r[1]]
    kept = rows(stages["simhash_near_dedup"](spark, docs, str(tmp_path)))
    fp = {t: plain_simhash(t or "") for t in [r.text for r in docs.collect()]}
    label = classes([(a, b) for a in fp.values() for b in fp.values() if (a ^ b).bit_count() <= 4])
    assert {label[fp[t]] for _, t in kept} == set(label.values())
    assert len({label[fp[t]] for _, t in kept}) == len(set(kept))
    assert [d for d, t in kept if t == near] == ["0"] and ("None", "alone here") in kept
    for stage in list(stages.values())[:-1]:
        assert stage(spark, odd, SMALL).columns == odd.columns and stage(spark, odd, SMALL).count() and stage(spark, odd.limit(0), SMALL).count() == 0


def test_pipeline_keeps_texts_when_no_row_is_labelled(spark, odd):
    import corpus_pipeline
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    for docs in (odd, odd.withColumn("lang", F.lit(None).cast("string"))):
        kept = sorted((str(r.doc_id), r.text) for r in stage(spark, docs, SMALL).collect())
        assert kept == sorted((str(r.doc_id), r.text) for r in odd.collect() if any(map(str.isalpha, r.text or "")))


def plain_passages(rows):
    """For distinct (id, hash of the text, text): the lines that stay."""
    seen = {}
    for d, h, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        line = (t or "").split("\n")
        for i in range(len(line) - 1):
            seen.setdefault((line[i], line[i + 1]), []).append((d, h, i))
    later = {(d, h, j) for at in seen.values() for d, h, i in at[1:] for j in (i, i + 1)}
    first = {(d, h, j) for at in seen.values() if len(at) > 1 for d, h, i in at[:1] for j in (i, i + 1)}
    return {(d, t): t and "\n".join(x for i, x in enumerate(t.split("\n")) if (d, h, i) not in later - first) for d, h, t in rows}


def test_passages(spark, odd):
    r = random.Random(8)
    word = lambda k, n: " ".join(f"{k}{r.randrange(10**6)}" for _ in range(n))
    planted = [[word(f"p{n}w", -(-60 // n)) for _ in range(n)] for n in range(2, 11) for _ in range(6)]
    rows = []
    for k, lines in enumerate(planted):
        for copy in range(3):
            rows.append((100 * copy + k, "\n".join([word("a", 9) for _ in range(r.randrange(4))] + lines + [word("b", 9) for _ in range(r.randrange(1, 4))])))
    r.shuffle(rows)
    out = {x.doc_id: x.text for x in line_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, lines in enumerate(planted):
        assert "\n".join(lines) in out[k]
        assert not any(line in out[100 * copy + k] for copy in (1, 2) for line in lines)
    assert all(len(out[d].split("\n")) == len([x for x in t.split("\n") if x[0] != "p" or d < 100]) for d, t in rows if out[d])
    mixed = [(r.choice([None, 1, 2, 3, i]), "\n".join(r.choice("abcdef") for _ in range(r.randrange(9)))) for i in range(60)] + [(9, None), (1, "x\nx\nx\nx"), (1, "x\nx\nx\nx")]
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    for docs in (spark.createDataFrame(mixed, "doc_id long, text string"), odd, small):
        keyed = [(x.doc_id, x.h, x.text) for x in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
        want = plain_passages(set(keyed))
        got = line_dedup.dedup_passages(docs)
        assert got.columns == [*docs.columns, "removed_lines"]
        assert sorted(map(str, ((x.doc_id, x.text) for x in got.collect()))) == sorted(map(str, ((d, want[d, t]) for d, _, t in keyed)))
    assert line_dedup.dedup_passages(odd.limit(0)).count() == 0


def test_pipeline_takes_out_short_passages(spark):
    import corpus_pipeline
    lines = [" ".join(f"{c}{i}" for i in range(30)) for c in "xy"]
    docs = spark.createDataFrame([(i, "\n".join([f"start {i}", *lines, f"end {i}"])) for i in range(5)], "doc_id long, text string")
    out = {x.doc_id: x.text for x in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SMALL).collect()}
    assert out == {0: "\n".join(["start 0", *lines, "end 0"]), **{i: f"start {i}\nend {i}" for i in range(1, 5)}}


def test_decontamination_of_short_items(spark):
    items = [(1, "Yes"), (2, "f = m a"), (3, "yes"), (4, "(x)"), (5, " \t"), (6, ""), (7, None), (8, "né?"), (9, "a longer item than others"), (10, "1"), (11, "elevenchars")]
    docs = [(0, "yes"), (1, "eyes yesterday yes_ YES"), (2, "F =\tm a"), (3, "f = m ab"), (4, "a(x)b"), (5, "Né? 10 21"), (6, None), (7, ""), (8, "not a longer item than others, 1"),
            (9, "x elevenchars"), (None, "ye"), (11, "s yes")]
    word = lambda t, at: 0 <= at < len(t) and t[at].isalnum()
    for some in (items, [i for i in items if i[0] != 9]):
        want = set()
        for (d, t), (k, b) in itertools.product(docs, some):
            t, b = ((x or "").lower().replace("\t", " ") for x in (t, b))
            found = [i for i in range(len(t)) if b.strip() and t.startswith(b, i)
                     and (len(b) >= 12 or not (word(t, i) and word(t, i - 1) or word(b, len(b) - 1) and word(t, i + len(b))))]
            want |= {(d, k, found[0], found[0] + len(b), 0)} if found else set()
        assert want and {(0, 1), (0, 3), (1, 1), (2, 2), (4, 4), (5, 8), (8, 10), (9, 11), (11, 1)} <= {w[:2] for w in want}
        got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(some, "item_id long, text string")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_decontamination_of_repetitive_text():
    """Runs of one q-gram cost about their length; counts equal those of all pairs."""
    rnd = random.Random(5)
    words = ["-", "- ", "ab", "abc", "| ", "x"]
    item_texts = ["".join(rnd.choice(words[:k]) for _ in range(40)) for k in (1, 1, 2, 2, 3, 6)] + ["-" * 60, "abcabc" * 8]
    texts = ["".join(rnd.choice(words[:k]) for _ in range(n)) for k in (1, 2, 3, 6) for n in (5, 60, 300)] + ["", "-" * 11]
    q = 12
    items = decontaminate.Items(list(enumerate(item_texts)), q, 0.06)
    line, starts, want = [], [], {}
    for t in texts:
        starts.append(len(line))
        line += [*decontaminate.codes(t).tolist(), *([0] * q)]
    for d, t in enumerate(texts):
        for i, own in enumerate(item_texts):
            for p, r in itertools.product(range(len(t) - q + 1), range(len(own) - q + 1)):
                if t[p:p + q] == own[r:r + q]:
                    k = i, d, (starts[d] + p - r + items.raised) // (int(items.edits[i]) + 1)
                    want[k] = want.get(k, 0) + 1
    h = decontaminate.grams(np.array(line, np.uint64), q)
    inside = np.ones(len(h), bool)
    for t, s in zip(texts, starts):
        inside[max(s, s + len(t) - q + 1):s + len(t) + q] = False
    got = zip(*(x.tolist() for x in items.strips(h, inside, lambda p: np.searchsorted(starts, p, side="right") - 1)))
    assert {x[:3]: x[3] for x in got} == want and len(want) > 400
    rules = decontaminate.Items([(1, "-" * 400)], q, 0.06)
    assert rules.search(["-" * 1_000_000]) == [(0, 0, 0, 400, 0)]
    assert rules.search([("-" * 390 + "\n") * 2_500]) == [(0, 0, 0, 400, 1)]
    assert rules.search(["- " * 400_000]) == []


def plain_cut(source, sink, edges):
    """The least source side of a minimum cut, by trying all labellings."""
    n = len(source)
    cost = lambda x: sum(sink[i] if x[i] else source[i] for i in range(n)) + sum(w for a, b, w in edges if x[a] != x[b])
    least = min(map(cost, itertools.product([0, 1], repeat=n)))
    best = [x for x in itertools.product([0, 1], repeat=n) if cost(x) == least]
    return [all(x[i] for x in best) for i in range(n)]


def test_minimum_cut_takes_the_least_text():
    r = random.Random(7)
    for _ in range(300):
        n = r.randrange(1, 9)
        source, sink = ([r.randrange(5) for _ in range(n)] for _ in range(2))
        edges = [(a, b, r.randrange(1, 4)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.4]
        assert html_extract.minimum_cut(source, sink, edges) == plain_cut(source, sink, edges)


def test_broken_and_very_large_pages():
    text = html_extract.main_text
    r = random.Random(8)
    body = lambda n: "".join(f"<p>{'word ' * (k % 13 + 1)}</p>" for k in range(n))
    assert text(body(100_000)).count("\n") > 50_000
    assert text("<a " * 350_000).startswith("<a <a")
    weak = "".join(f"<div>{'w ' * r.choice([1, 2, 5, 7, 8, 9, 12])}</div>" for _ in range(100_000))
    assert len(html_extract.blocks(weak)) == 100_000 and text(weak)
    for page in ('<a ">"' * 160_000, "<div>x y" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<script>" + "</script" * 100_000,
                 "<a " + "x" * 1_000_000 + ">", "<!--" * 200_000, "<" * 1_000_000):
        text(page)
    # a quote in a script does not reach into the page behind it
    assert text("<p>A first paragraph of an article, it has some length.</p><script>if (a<b) s=\"x</script><p>Another \"one\" here, with a good many words too.</p>") \
        == "A first paragraph of an article, it has some length.\nAnother \"one\" here, with a good many words too."
    assert text("<p>A reference &#" + "9" * 6000 + "; beyond all and &#0000000065; with zeros in front of it.</p>") \
        == "A reference � beyond all and A with zeros in front of it."


def test_language_sample_of_a_hot_id(spark):
    """Copies under one id are one row of the sample; other texts under that id are rows of their own."""
    rows = [(1, "the same sentence of a hot document", "en")] * 3000 + [(1, f"another text number {i} of it", "en") for i in range(40)] \
        + [(2, f"der Satz Nummer {i} ist ein anderer", "de") for i in range(40)]
    seen = []
    model, fit = langid.LanguageModel, lambda x, langs: seen.append(list(langs)) or model(x, langs)
    langid.LanguageModel = fit
    try:
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4000)
    finally:
        langid.LanguageModel = model
    assert seen[0].count("en") == 41 and seen[0].count("de") == 40


def test_line_dedup_of_a_long_text(spark):
    """A text of many chunks, most of them removed, ends in about linear time."""
    text = "\n".join(f"line {i % 60_000} of text" for i in range(120_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got.text.count("\n") + 1 + got.removed_lines == 120_000 and got.removed_lines > 50_000
    assert set(got.text.split("\n")) == set(text.split("\n"))
