"""Row numbers and ranks on many wide rows, label counts, copied settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokensieve.operators import kernels as K
from tokensieve.operators.evaluate import global_row_number
from tokensieve.operators.groupwise import group_rank
from tokensieve.operators.select import important_topk, uniform_sample, weighted_sample
from tokensieve.sources import sinks


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_row_numbers_keep_every_row(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n = 200_000
        wide = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 200).alias("a"), F.sha2(F.col("id").cast("string"), 512).alias("b"))
        out = global_row_number(wide, "k", "i").agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i"), F.max(F.length("a"))).first()
        assert tuple(out) == (n, n, 1, n, 200)
        hot = wide.select((F.col("k") % 2 == 0).cast("int").alias("g"), "k", "b")
        one = group_rank(hot, "g", [F.asc("k")], "r", largest=n, max_group=n)
        many = group_rank(hot, "g", [F.asc("k")], "r", largest=n, max_group=5)
        assert one.exceptAll(many).count() == 0 and many.count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_kernels_follow_their_rules():
    r = np.random.default_rng(4)
    for _ in range(30):
        x = K.normalise_rows(r.standard_normal((int(r.integers(1, 30)), 5)))
        n, k = len(x), int(r.integers(1, 12))
        w = r.random(n)
        score, left, want = w.copy(), set(range(n)), []
        while left and len(want) < k:
            j = max(left, key=lambda i: (score[i], -i))
            want.append(j)
            left.discard(j)
            score = score - K.DIVERSITY_PENALTY * (x @ x[j])
        assert K.text_guided(x, w, k) == want
        kept = K.dedup_even_odd(x, min(k, n))
        assert len(kept) == min(k, n) == len(set(kept))
        chosen = K.cluster_representatives(x, k, r.permutation(n))
        assert len(chosen) == len(set(chosen)) <= k
        centres, own = K.kmeans_lloyd(x, min(k, n), r.permutation(n), max_iters=50)
        gaps = ((x[:, None] - centres[None]) ** 2).sum(-1)
        assert np.allclose(gaps[np.arange(n), own], gaps.min(axis=1))


def test_farthest_first():
    points = np.array([[0.0], [1.0], [10.0], [4.0], [10.0]])
    assert K.farthest_first(points, 4, 0).tolist() == [0, 2, 3, 1]


def test_literal_k_cuts_groups_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("token_idx"), F.rand(3).alias("s"))
    for top in (important_topk(rows, "g", "s", 5), weighted_sample(rows, "g", "s", 5), uniform_sample(rows, "g", 5)):
        assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
        assert top.count() == 10


def test_sinks_round_trip(spark, tmp_path):
    texts = ["", None, ' b) "quoted", maybe\n', "a\rb", "  "]
    results = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "test_number long, generated_text string, keep_ratio double")
    path = str(tmp_path / "csv")
    assert sinks.write_per_config(results, path, keys=("keep_ratio",))
    back = sinks.read_results_csv(spark, path, sinks.results_projection(results, extra=("keep_ratio",)).schema)
    assert sorted(back.select("test_number", "generated_text", "keep_ratio", "method").collect(), key=lambda r: r[0]) == [(i, t, 0.5, "") for i, t in enumerate(texts)]
    assert not sinks.write_results_csv(results.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()

    payloads = spark.createDataFrame([(1, "a.png", b"old"), (2, "a.png", b"new"), (3, "b.png", bytes(range(256))), (4, "c.png", None)], "row_id long, n string, p binary")
    files = sinks.final_files(sinks.payload_manifest(payloads, "n", "p", "row_id"))
    sinks.write_payload_files(files, str(tmp_path / "files"))
    sinks.write_payload_files(files, str(tmp_path / "files"))
    assert {r.file_name: bytes(r.payload) for r in sinks.read_payload_files(files, str(tmp_path / "files")).collect()} == {"a.png": b"new", "b.png": bytes(range(256))}
    assert {f.name: f.read_bytes() for f in (tmp_path / "files").iterdir() if not f.name.endswith(".crc")} == {"a.png": b"new", "b.png": bytes(range(256))}
