"""Question views, tiles, split k-means and lazy greedy selection against
plain versions on groups of other sizes than the given tables have."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokensieve.catalog import all_queries
from tokensieve.operators import clusters as C
from tokensieve.operators import kernels as K
from tokensieve.operators import lazy as L
from tokensieve.operators import scores as SC
from tokensieve.operators import tiles as TL
from tokensieve.sources import tables as tb


def vectors(spark, groups, n, dims=8, seed=0, name="token_idx"):
    r = np.random.default_rng(seed)
    x = r.standard_normal((groups * n, dims))
    table = pa.table({"group_id": np.repeat(np.arange(groups), n), name: np.tile(np.arange(n), groups), "vec": pa.array(x.tolist())})
    return spark.createDataFrame(table), x.reshape(groups, n, dims)


def test_conversations_of_many_turns_keep_their_answers(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t}") for c, n in ((1, 10), (2, 150)) for t in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = all_queries()["response_join"](spark, str(tmp_path)).collect()
    assert len(rows) == len({r.question_id for r in rows}) == 80
    for r in rows:
        conv, turn = r.question_id.split(":")
        assert r.generated_text == f"c{conv} t{int(turn) + 1}"


def test_question_vectors_grow_with_the_table(spark, tmp_path):
    n = 25 * 400
    spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % 25).cast("int").alias("label"),
                          F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    per = {r.group_id: r["count"] for r in tb.text_tokens(spark, str(tmp_path)).groupBy("group_id").count().collect()}
    assert set(per) == set(range(25)) and 0.1 < sum(per.values()) / n < 0.15 and min(per.values()) > 20


def test_tiles_equal_whole_matrices(spark):
    """25 groups, 1,000 question vectors each, and tiles smaller than either side."""
    tokens, x = vectors(spark, 25, 60)
    questions, q = vectors(spark, 25, 1000, seed=1, name="t_idx")
    sim = np.einsum("gnd,gqd->gnq", x, q)
    top = TL.largest_similarity(tokens, questions, ["group_id"], tile=256).collect()
    assert len(top) == 1500 and all(abs(r.text_score - sim[r.group_id, r.token_idx].max()) < 1e-9 for r in top)
    a = np.exp(sim - sim.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    got = TL.attention_sums(tokens, questions, ["group_id"], tile=32).where("group_id < 3").collect()
    assert len(got) == 180 and all(abs(r.attention - a[r.group_id, r.token_idx].sum()) < 1e-9 and r.n_questions == 1000 for r in got)
    p = np.maximum(a / (a.sum(axis=2, keepdims=True) + 1e-10), 1e-10)
    h = -(p * np.log(p)).sum(axis=2)
    got = TL.attention_entropy(tokens, questions, ["group_id"], tile=500).collect()
    assert len(got) == 1500 and all(abs(r.entropy - h[r.group_id, r.token_idx]) < 1e-9 for r in got)
    cos = np.einsum("gnd,gqd->gnq", x / np.linalg.norm(x, axis=2, keepdims=True), q / np.linalg.norm(q, axis=2, keepdims=True))
    rel = -cos.mean(axis=2)
    low, high = rel.min(axis=1, keepdims=True), rel.max(axis=1, keepdims=True)
    want = (rel - low + 1e-6) / (high - low)
    assert all(abs(r.relevance - want[r.group_id, r.token_idx]) < 1e-9 for r in SC.query_relevance(tokens, questions).collect())


def test_tiles_of_nulls_and_empty_sides(spark):
    tokens = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, None), (1, 3, [1.0, 1.0]), (None, 4, [1.0, 1.0])], "group_id long, token_idx long, vec array<double>")
    questions = spark.createDataFrame([(0, 7, [2.0, 0.0]), (0, 8, None), (2, 9, [1.0, 1.0])], "group_id long, t_idx long, vec array<double>")
    assert [tuple(r) for r in TL.similarity_rows(tokens, questions, ["group_id"]).collect()] == [(0, 7, 1, 2.0)]
    assert TL.attention_sums(tokens, questions, ["group_id"]).collect()[0].attention == 1.0
    assert TL.largest_similarity(tokens, questions.limit(0), ["group_id"]).count() == 0
    assert TL.attention_entropy(tokens.limit(0), questions, ["group_id"]).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_split_kmeans_equals_the_kernel(spark, seed):
    df, x = vectors(spark, 3, 2500, seed=seed)
    df = df.unionByName(spark.createDataFrame([(7, i, [float(i)] * 8) for i in range(3)], df.schema)).repartition(7)
    u = df.select("group_id", "token_idx", C.uniform(42, F.col("group_id"), F.col("token_idx")).alias("u")).toPandas().sort_values(["group_id", "token_idx"])
    own = {(r.group_id, r.token_idx): r.cluster for r in C.kmeans_assign(df, ["group_id"], 9).collect()}
    picks = sorted((r.group_id, r.pick_rank, r.token_idx) for r in C.cluster_select(df, ["group_id"], 5).collect())
    want = []
    for g in (0, 1, 2, 7):
        m = x[g] if g < 3 else np.array([[float(i)] * 8 for i in range(3)])
        init = np.argsort(u[u.group_id == g].u.to_numpy(), kind="stable")
        assert [own[g, i] for i in range(len(m))] == K.kmeans_lloyd(m, min(9, len(m)), init)[1].tolist()
        want += [(g, k, j) for k, j in enumerate(K.cluster_representatives(m, 5, init))]
    assert picks == sorted(want)
    assert C.kmeans_assign(df.limit(0), ["group_id"], 3).count() == 0


def test_lazy_maxmin_equals_the_kernel_in_few_rounds(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((20, 16))
    x = K.normalise_rows(centres[r.integers(0, 20, 6000)] + r.standard_normal((6000, 16)))
    rows = [(0, i, v, 1200) for i, v in enumerate(x.tolist())] + [(1, i, v, 50) for i, v in enumerate(x[:2000].tolist())] + \
        [(2, i, v, 9) for i, v in enumerate(x[:5].tolist())] + [(3, i, v, 0) for i, v in enumerate(x[:5].tolist())]
    df = spark.createDataFrame(rows, "g int, token_idx long, vec array<double>, k int").withColumn("u", -F.col("token_idx")).repartition(6)
    got, rounds = L.lazy_rounds(df, ["g"])
    by = {}
    for p in sorted(got.collect(), key=lambda p: p.pick_rank):
        by.setdefault(p.g, []).append(p.token_idx)
    assert by == {0: K.maxmin_diverse(x, 1200), 1: K.maxmin_diverse(x[:2000], 50), 2: [0, 1, 2, 3, 4]}
    assert rounds < 20
    last = [p.token_idx for p in sorted(L.lazy_maxmin(df.where("g = 1"), ["g"], start_col="u").collect(), key=lambda p: p.pick_rank)]
    assert last == K.maxmin_diverse(x[:2000], 50, 1999)
    assert L.lazy_maxmin(df.limit(0), ["g"]).count() == 0


def test_lazy_dpp_equals_the_kernel_in_few_rounds(spark):
    r = np.random.default_rng(5)
    x, rel = K.normalise_rows(r.standard_normal((4000, 64))), r.random(4000) + 0.1
    rows = [(0, i, v, float(w), 40) for i, (v, w) in enumerate(zip(x.tolist(), rel))] + [(1, i, x[i].tolist(), float(rel[i]), 9) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, token_idx long, vec array<double>, relevance double, k int").repartition(6)
    by = {0: [], 1: []}
    for p in sorted(L.lazy_dpp(df, ["g"]).collect(), key=lambda p: p.pick_rank):
        by[p.g].append(p.token_idx)
    assert by == {0: K.dpp_map(x, rel, 40), 1: K.dpp_map(x[:5], rel[:5], 9)}
    assert L.lazy_dpp(df.limit(0), ["g"]).count() == 0


def test_seeded_selection_of_large_groups(spark):
    df, _ = vectors(spark, 2, 300)
    a, b = (sorted(map(tuple, K.diverse_maxmin_seeded(df, ["group_id"], 12, max_group=m).collect())) for m in (10**6, 100))
    assert a == b


def test_group_statistics_without_windows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (None, 800.0), (None, 790.0), (2, None)], "group_id long, s double")
    rows = SC.softmax(df, "group_id", "s", "p")
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    e = np.exp([-2.0, 0.0])
    got = {(r.group_id, r.s): r.p for r in rows.collect()}
    assert got[1, 1.0] == pytest.approx(e[0] / e.sum()) and got[None, 790.0] == pytest.approx(np.exp(-10) / (1 + np.exp(-10)))
    assert len(got) == 5 and got[2, None] is None


def test_running_sums_of_a_hot_group_lie_in_many_tasks(spark):
    from tokensieve.operators.numbering import number_in_groups
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.lit(1)).otherwise(F.lit(0)).alias("g"), F.col("id").alias("token_idx"),
                               (F.pmod(F.xxhash64("id"), F.lit(1000)) / 8).alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = number_in_groups(df, ["g"], [F.desc("s"), F.asc("token_idx")], "s", "p", "c")
        assert out.where("g = 0").select(F.spark_partition_id().alias("i")).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    t = out.toPandas().sort_values(["g", "s", "token_idx"], ascending=[True, False, True])
    for _, own in t.groupby("g"):
        assert own.p.tolist() == list(range(len(own))) and np.allclose(own.c, own.s.cumsum())


def test_adaptive_ratios_of_a_large_group(spark):
    r = np.random.default_rng(0)
    s = np.sort(r.exponential(size=50_000))[::-1]
    df = spark.createDataFrame(pa.table({"group_id": np.zeros(len(s), int), "token_idx": np.arange(len(s)), "cls_score": s}))
    got = SC.adaptive_keep_ratio(df).first()
    n = len(s)
    assert got.elbow_ratio == pytest.approx((np.argmax(s[:-2] - 2 * s[1:-1] + s[2:]) + 2) / n)
    assert got.statistical_ratio == pytest.approx((s > s.mean() + 0.5 * s.std(ddof=1)).sum() / n)
    assert abs(got.importance_ratio * n - ((s.cumsum() <= 0.8 * s.sum()).sum() + 1)) <= 1
