"""Greedy kernels against brute force, the distributed path against the
in-task path, and selection properties of the pruning plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from tokensieve.operators import kernels as K
from tokensieve.plans import pruners as P
from tokensieve.sources import tables as tb


def brute_maxmin(x, k, start=0):
    n = len(x)
    if n <= k:
        return list(range(n))
    sel = [start]
    while len(sel) < k:
        best, bj = None, None
        for j in range(n):
            if j in sel:
                continue
            m = max(float(x[j] @ x[s]) for s in sel)
            if best is None or m < best:
                best, bj = m, j
        sel.append(bj)
    return sel


def brute_text_guided(x, w, k):
    score = list(map(float, w))
    avail = [True] * len(x)
    out = []
    for _ in range(min(k, len(x))):
        j = max((i for i in range(len(x)) if avail[i]), key=lambda i: (score[i], -i))
        out.append(j)
        avail[j] = False
        for i in range(len(x)):
            if avail[i]:
                score[i] -= 0.8 * float(x[i] @ x[j])
    return out


def test_maxmin_hand_case():
    x = np.array([[1, 0], [0.8, 0.6], [0, 1], [-1, 0]], dtype=float)
    assert K.maxmin_diverse(x, 2, 0) == [0, 3]


def test_text_guided_hand_case():
    x = np.array([[1, 0], [1, 0], [0, 1]], dtype=float)
    assert K.text_guided(x, np.array([1, 0.9, 0.5]), 2) == [0, 2]


@pytest.mark.parametrize("seed", range(5))
def test_kernels_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = K.normalise_rows(rng.normal(size=(30, 5)))
    assert K.maxmin_diverse(x, 8, 0) == brute_maxmin(x, 8, 0)
    w = rng.random(30)
    assert K.text_guided(x, w, 8) == brute_text_guided(x, w, 8)


def test_dpp_picks_distinct_and_sized():
    rng = np.random.default_rng(1)
    x = K.normalise_rows(rng.normal(size=(40, 6)))
    picks = K.dpp_map(x, rng.random(40) + 0.1, 12)
    assert len(picks) == 12 and len(set(picks)) == 12


def test_dedup_even_odd_reaches_target():
    rng = np.random.default_rng(2)
    x = K.normalise_rows(rng.normal(size=(21, 4)))
    out = K.dedup_even_odd(x, 7)
    assert len(out) == 7 and len(set(out)) == 7


@pytest.mark.parametrize("nearest, block", [(2, 64), (32, 1 << 22)])
def test_dedup_even_odd_equals_left_to_right_rule(monkeypatch, nearest, block):
    """Also with equal rows, whose closeness ties, and with a NaN."""
    monkeypatch.setattr(K, "NEAREST", nearest)
    monkeypatch.setattr(K, "NEAREST_BLOCK", block)
    r = np.random.default_rng(3)
    for t in range(40):
        n, d, target = int(r.integers(1, 60)), int(r.integers(2, 9)), int(r.integers(1, 13))
        x = K.normalise_rows(r.normal(size=(n, d)))
        x = x[r.permutation(np.r_[np.arange(n), r.integers(0, n, n // 2)])]
        if t % 8 == 7:
            x[r.integers(0, len(x))] = np.nan
        sim = np.zeros((len(x), len(x)))
        for c in range(d):
            sim += x[:, c, None] * x[None, :, c]
        line = list(range(len(x)))
        while len(line) > target:
            even, odd = line[0::2], line[1::2]
            close = sim[np.ix_(even, odd)].max(axis=1, initial=-np.inf)
            order = np.lexsort((np.arange(len(even)), -close))
            line = [even[i] for i in order[min(2, len(line) - target):]] + odd
        assert K.dedup_even_odd(x, target) == line


def test_dedup_even_odd_compares_all_rows_a_few_times_only(monkeypatch):
    """Not in every round: 1,000 rows take 494 rounds."""
    calls, dots = [], K._pair_dots
    monkeypatch.setattr(K, "_pair_dots", lambda x, i, y, j: calls.append(len(i)) or dots(x, i, y, j))
    x = K.normalise_rows(np.random.default_rng(5).normal(size=(1000, 16)))
    assert len(K.dedup_even_odd(x, 12)) == 12
    assert 0 < sum(calls) < 200_000  # all rounds together compare 41 million pairs


def _picks(df):
    return sorted((r["group_id"], r["pick_rank"], r["token_idx"]) for r in df.collect())


def test_spark_maxmin_equals_numpy(spark):
    t = tb.tokens(spark, SF_MID)
    got = _picks(K.diverse_maxmin(t, ["group_id"], 6))
    rows = t.collect()
    expect = []
    for g in sorted({r["group_id"] for r in rows}):
        rs = sorted((r for r in rows if r["group_id"] == g), key=lambda r: r["token_idx"])
        x = K.normalise_rows(np.array([r["vec"] for r in rs]))
        for rank, j in enumerate(brute_maxmin(x, 6, 0)):
            expect.append((g, rank, rs[j]["token_idx"]))
    assert got == sorted(expect)


@pytest.mark.parametrize("op", ["maxmin", "text_guided", "dpp"])
def test_distributed_path_equals_in_task_path(spark, op):
    t = tb.tokens(spark, SF_MID).where(F.col("group_id") < 3)
    if op == "maxmin":
        a, b = K.diverse_maxmin(t, ["group_id"], 6), K.diverse_maxmin(t, ["group_id"], 6, max_group=5)
    elif op == "text_guided":
        t = t.withColumn("weight", F.col("cls_score"))
        a, b = K.diverse_text_guided(t, ["group_id"], 6), K.diverse_text_guided(t, ["group_id"], 6, max_group=5)
    else:
        t = t.withColumn("relevance", F.col("cls_score") + 0.1)
        a, b = K.dpp_select(t, ["group_id"], 6), K.dpp_select(t, ["group_id"], 6, max_group=5)
    assert _picks(a) == _picks(b)


def test_pairwise_block_memory_is_bounded():
    """12,000 rows: two blocks of products and their mask, not 12,000 rows of them."""
    import tracemalloc
    x = K.normalise_rows(np.random.default_rng(6).normal(size=(12_000, 2)))
    ids = np.arange(len(x))
    tracemalloc.start()
    top, total, n = K._block_summary(x, x, ids, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    sim = x[:5] @ x.T
    assert np.allclose(total[:5], sim.sum(axis=1) - 1) and (n == len(x) - 1).all()
    sim[np.arange(5), np.arange(5)] = -np.inf
    assert np.allclose(top[:5], sim.max(axis=1))


def test_large_groups_are_told_apart_without_a_shuffle(spark):
    rows = spark.createDataFrame([(g, t) for g, n in ((0, 3), (1, 9), (None, 12)) for t in range(n)], "group_id long, token_idx long")
    seen = {}
    both = K.dispatch_by_size(rows, ["group_id"], lambda d: seen.setdefault("small", d), lambda d: seen.setdefault("large", d), max_group=5)
    assert sorted((r.group_id, r.token_idx) for r in both.collect()) == [(0, t) for t in range(3)] + [(1, t) for t in range(9)]
    assert {r.group_id for r in seen["large"].collect()} == {1}
    assert "SortMergeJoin" not in both._jdf.queryExecution().toString()


def test_pairwise_tiled_equals_whole(spark):
    t = tb.tokens(spark, SF_MID).where(F.col("group_id") < 3)
    a = {(r[0], r[1]): (round(r[2], 9), round(r[3], 9)) for r in K.pairwise_summary(t, ["group_id"]).collect()}
    b = {(r[0], r[1]): (round(r[2], 9), round(r[3], 9))
         for r in K.pairwise_summary(t, ["group_id"], max_group=10, tile=16).collect()}
    assert a == b


def test_pairwise_similarity_has_every_pair(spark, tmp_path, monkeypatch):
    """A row for each two tokens of a group, by blocks and tiles too; nulls and repeated ids as in the SQL."""
    import duckdb
    from tokensieve.catalog import vectorq
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=4).round(2).tolist(), 0 if i < 25 else 1) for i in range(40)]
    rows += [rows[3], (40, None, 0), (41, None, 0), (42, [1.0, 0.0, 0.0, 0.0], 2), (43, [0.0] * 4, 0), (44, [1.0] * 4, None), (45, None, 3), (46, [1.0] * 4, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    ordered = lambda rs: sorted((tuple(x) for x in rs), key=lambda x: [(v is not None, v) for v in x])
    want = ordered(con.execute(vectorq.SQL["pairwise_similarity"]).fetchall())
    assert len(want) == 29 * 28 - 2 + 15 * 14 + 2
    got = vectorq.q_pairwise_similarity(spark, str(tmp_path))
    assert got.columns == ["group_id", "token_idx", "other_idx", "sim", "max_sim", "mean_sim"]
    assert ordered(got.collect()) == want
    monkeypatch.setattr(K, "PAIR_BLOCK", 4)
    t = tb.tokens(spark, str(tmp_path))
    tiled = K.pairwise_rows(t, K.pairwise_summary(t, ["group_id"], max_group=10, tile=8), ["group_id"], tile=8)
    assert ordered(tiled.select("group_id", "token_idx", "other_idx", *[F.round(c, 6) for c in ("sim", "max_sim", "mean_sim")]).collect()) == want


def test_c1_selection_properties(spark):
    t = tb.tokens(spark, SF_MID)
    cf = tb.configs(spark)
    sel = P.prune_attention_diverse(t, tb.text_tokens(spark, SF_MID), cf, presample_threshold=20).collect()
    n = {r["group_id"]: r["n"] for r in t.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    cfgs = {r["config_id"]: r for r in cf.collect()}
    by = {}
    for r in sel:
        by.setdefault((r["config_id"], r["group_id"]), []).append(r)
    for (c, g), rows in by.items():
        toks = [r["token_idx"] for r in rows]
        assert len(toks) == len(set(toks)), "a token selected twice"
        keep = min(int(cfgs[c]["keep_ratio"] * n[g]), n[g])
        rec = max(min(int(cfgs[c]["recovery_ratio"] * n[g]), n[g] - keep), 0)
        assert len(rows) == (n[g] if keep >= n[g] else keep + rec)
        pos = sorted(r["position"] for r in rows)
        assert pos == list(range(len(rows)))
