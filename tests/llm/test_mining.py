"""Toxicity, centroid clustering and phrase mining against brute force, and the
cases that their docstrings define."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tokensieve.llm import centroids, phrases, queries, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n long, key long, shard int, h long, score double, toxic int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 1, 2, 3, 4, .5, 6) for i, t, lang in rows], DOC)


# ------------------------------------------------------------------ centroid clustering
def brute_clusters(rows, k, rounds, dims, scale, seed):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) * scale < centroids.LIMIT for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v]))
    sha = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [q for _, _, q in sorted((sha(i), q, q) for i, q in kept)[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[nearest(q)[1]].append(q)
        cents = [[sum(col) // len(own[n]) for col in zip(*own[n])] if own[n] else c for n, c in enumerate(cents)]
    found = [(i, *nearest(q)) for i, q in kept]
    per = Counter()
    for _, d, n in found:
        per[n] += d
    return sorted(((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


def test_tree_finds_the_nearest_centroid_and_the_smaller_number_on_ties():
    r = np.random.default_rng(3)
    for size in (1, 2, 5, 40):
        c = r.integers(-6, 6, (size, 3))
        x = r.integers(-8, 8, (700, 3))
        own, best = centroids.VantageTree(c).nearest(x)
        gaps = ((x[:, None] - c[None]) ** 2).sum(-1)
        assert (own == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()
    assert len(centroids.VantageTree(c).nearest(x[:0])[0]) == 0


def test_tree_leaves_out_far_centroids():
    c = np.array([[i * 1000, 0] for i in range(64)])
    seen = []
    tree = centroids.VantageTree(c)
    old, centroids.squares = centroids.squares, lambda x, p: seen.append(len(x)) or ((x - p) ** 2).sum(axis=1)
    try:
        assert tree.nearest(c + 1)[0].tolist() == list(range(64))
    finally:
        centroids.squares = old
    assert sum(seen) < 64 * 64 / 2


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(4) + 3 * (i % 3)).tolist()) for i in range(150)]
    rows += [rows[3], rows[3], (900, [0.5, 0.5, None, 1.0]), (901, None), (902, [1.0] * 3), (903, [math.nan, 0.0, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]),
             (None, [0.25, -0.25, 3.0, 1.0]), (None, [9.0, 1.0, 1.0, 1.0]), (905, [1e30, 0.0, 0.0, 0.0]), (906, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "q") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance long, q string")
    for k in (7, 400):
        got = centroids.cluster(df, k=k, rounds=3, dims=4, scale=16, seed=9)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, k, 3, 4, 16, 9)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance, r.inertia) for r in centroids.cluster(same, k=4, rounds=2, dims=2).collect()} == {(0, 0, 0)}
    assert centroids.cluster(df.limit(0), k=4, dims=4).count() == 0


# ------------------------------------------------------------------ phrase mining
def brute_phrases(rows, support, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in (text or "").translate(phrases_table()).split("\n"):
            words = piece.split()
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    best = defaultdict(int)
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                best[lang, w[i:i + k]] = max(best[lang, w[i:i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * best[lang, w] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
                  for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def phrases_table():
    table = {c: c + 32 for c in range(65, 91)}
    return table | {c: "\n" for c in map(ord, ".,;:!?\n\x0b\x0c\r")} | {9: " "} | {c: f"<{c}>" for c in (0x85, 0xa0, 0x2028, 0x1c)}


def test_phrases_equal_brute_force(spark):
    r = np.random.default_rng(1)
    words = ["Alpha", "beta", "gamma", "délta", "É", "x1", "of", "the"]
    rows = [(i, "".join(words[j] + sep for j, sep in zip(r.integers(0, 8, 40), r.choice([" ", "  ", "\t", ". ", "\n", "!"], 40, p=[.7, .05, .05, .1, .05, .05]))),
             ["en", "de", None][i % 3]) for i in range(60)]
    rows += [rows[0], rows[0], (7, None, "en"), (None, "", None), (None, "of the of the of the", "en"), (8, "of the " * 200_000, "en"), (9, "a" * 2_000_000, "de"),
             (10, " \t. ,", "fr"), (11, "und then und then", "und")]
    df = docs_of(spark, rows).repartition(5)
    for support, top in ((3, 2000), (5, 6)):
        got = phrases.collocations(df, support=support, top=top, shards=3)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute_phrases(rows, support, top)
    assert phrases.collocations(df.limit(0), support=2).count() == 0
    assert phrases.collocations(df, support=10**7).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 9 * 10**12 + 1, 10**12 + 9, 10**12 + 11), (100, 10**13, 100, 100), (3, 7, 11, 13), (10**6, 10**13, 10**13, 10**13)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [x[0] for x in df.select(phrases.exact_score(*(df[c] for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_equal_hashes_are_told_apart_by_words():
    ids = np.array([1, 2, 0, 3, 4, 0, 1, 2])
    first, n = phrases._same(ids, np.zeros(8, int), np.zeros(8, np.uint64), np.array([0, 3, 6]), 2)
    assert sorted(zip(ids[first].tolist(), n.tolist())) == [(1, 2), (3, 1)]


def test_long_texts_are_read_in_slices():
    text = b" ".join(b"w%d" % i for i in range(500_000)) + b"," + b"z" * 3_000_000 + b" end"
    parts = list(phrases.word_lists(text))
    assert len(parts) > 3 and [w for p in parts for w in p if w != phrases.STOP] == text.replace(b",", b" ").split()


# ------------------------------------------------------------------ toxicity
def brute_segments(score):
    """Every maximal scoring segment: the best one, then those left and right of it."""
    if not (score > 0).any():
        return []
    total = np.concatenate([[0], np.cumsum(score)])
    best, span = 0, None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            if total[j] - total[i] > best + 1e-9:
                best, span = total[j] - total[i], (i, j)
    i, j = span
    return brute_segments(score[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(score[j:])]


def test_segments_equal_brute_force():
    r = np.random.default_rng(2)
    for _ in range(200):
        score = r.choice([-3, -2, -1, 1, 2, 5], int(r.integers(0, 25))) + r.random() * 1e-3 * r.random(1)
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(score)]
        want = [(a, b, round(s, 6)) for a, b, s in brute_segments(score)]
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
        assert len(got) == len(want)


def test_segments_take_linear_time():
    score = np.where(np.arange(400_000) % 2, 1.0, -1.0 - 1e-6)
    assert len(toxicity.maximal_segments(score)) == 200_000
    assert len(toxicity.maximal_segments(np.tile([2.0, -1.0], 200_000))) == 1


def test_scale_solves_its_equation():
    s, n = np.array([-2.0, -1.0, 1.5]), np.array([50.0, 40.0, 10.0])
    assert (np.exp(toxicity.solve_scale(s, n) * s) * n).sum() == pytest.approx(n.sum())
    assert toxicity.solve_scale(-s[:1], n[:1]) == 1.0


def test_toxic_texts_are_found_and_located(spark):
    r = np.random.default_rng(7)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "Lorem", "sed", "do", "ut", "elit"]
    def text(i):
        words = r.choice(plain, 60).tolist()
        if i % 5 == 0:
            words[20:23] = ["Vile", "rotten", "vileness"]
        return " ".join(words)
    rows = [(i, text(i), "en") for i in range(1500)]
    labels = [(i, int(i % 5 == 0), "x") for i in range(1500) if i % 2 == 0] + [(2, None, "x"), (None, 1, "x"), (4, 0, "x"), (99_999, 1, "x")]
    odd = [(5001, None, "en"), (5002, "", "en"), (5003, "12 . 3", None), (None, "lorem vile rotten", "en"), (5004, "lorem ipsum dolor " * 200_000 + "vile rotten vileness", "en"), rows[5], rows[5]]
    df = docs_of(spark, rows + odd)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) + len(odd)
    for x in got:
        assert x.held_out == (x.doc_id is None or zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
        if x.doc_id is not None and x.doc_id < 1500:
            assert x.predicted == int(x.doc_id % 5 == 0)
            if x.predicted:
                assert [rows[x.doc_id][1][p.start:p.end] for p in x.passages] == ["Vile rotten vileness"]
    by = {x.doc_id: x for x in got}
    assert by[5001].score == by[5002].score == by[5003].score < 0.1
    assert [odd[4][1][p.start:p.end] for p in by[5004].passages] == ["vile rotten vileness"]
    assert {x.score for x in toxicity.toxicity(df, lab.limit(0)).collect()} == {0.0}
    assert {x.score for x in toxicity.toxicity(df, lab.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_toxicity_on_held_out_documents(spark):
    rows = queries.op11_toxicity(spark, SF).collect()
    label = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    held = [(x.score, label[x.doc_id]) for x in rows if x.held_out and x.doc_id in label]
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + .5 * (a == b) for a in toxic for b in clean]) > 0.9
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)
