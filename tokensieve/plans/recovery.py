"""Recovery variants and the text-guided pruner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise
from ..operators import clusters as C
from ..operators import kernels as K
from ..operators import scores as SC
from ..operators import select as S
from ..session import written
from . import pruners as P

G = "group_id"


# J8 (+ V10)
def centroid_scores(tokens: DataFrame, text_tokens: DataFrame, k_clusters: int = 128, seed: int = 42) -> DataFrame:
    """k-means per group (V10); each centroid scored by a softmax over the
    centroids of question.centroid, mean over questions; the score is
    mapped back to every member token (equi-join on the cluster id)."""
    assign = written(C.kmeans_assign(tokens, [G], k_clusters, seed), "cluster-members")
    members = tokens.join(assign, [G, "token_idx"])
    cent = SC.mean_vector(members, [G, "cluster"], "vec", "centroid")
    cs = S.recovery_scores(cent.select(G, F.col("cluster").alias("token_idx"), F.col("centroid").alias("vec")), text_tokens, [G]) \
        .select(G, F.col("token_idx").cast("int").alias("cluster"), F.col("recovery_score").alias("centroid_score"))
    return assign.join(cs, [G, "cluster"]).select(G, "token_idx", "cluster", "centroid_score")


# V11
def centroid_recovery(pruned: DataFrame, text_tokens: DataFrame, k_clusters: int = 128, k: int = 5,
                      seed: int = 42) -> DataFrame:
    """Pruned tokens scored through cluster centroids (J8), top-k. Groups of
    every size take this way; a caller who wants them scored one by one calls
    ``recover_topk`` (W13)."""
    scored = centroid_scores(pruned, text_tokens, k_clusters, seed)
    return S.top_desc(scored.select(G, "token_idx", F.col("centroid_score").alias("recovery_score")), G, "recovery_score", k)


# V12
def recover_diverse(pruned: DataFrame, text_tokens: DataFrame, k: int) -> DataFrame:
    """Top ``2k`` by recovery score, then max-min diversity among them (in
    score order); plain top-k when ``k == 1``."""
    cand = S.recover_topk(pruned, text_tokens, G, 2 * k)
    if k <= 1:
        return cand.where(F.col("rank") < k).select(G, "token_idx", "rank")
    c = cand.join(pruned.select(G, "token_idx", "vec"), [G, "token_idx"]).withColumn("vec", l2_normalise("vec")) \
        .withColumn("k", F.lit(k)).withColumn("_ord", F.col("rank").cast("bigint"))
    picks = K.maxmin(c, [G], order_col="_ord", largest=2 * k)
    return picks.select(G, "token_idx", F.col("pick_rank").alias("rank"))


# C3
def prune_text_guided(tokens: DataFrame, text_tokens: DataFrame, configs: DataFrame, weight: float = 0.5) -> DataFrame:
    """Hybrid importance ``(1-w)*norm(cls) + w*norm(text)`` (W11) -> top
    important by it -> text-guided diverse fill weighted by it (V4) ->
    recovery (V12): of the tokens ranked by question attention (W13) the first
    ``2k``, and of these ``k`` diverse ones, for each configuration's ``k``."""
    ts = SC.max_pool_similarity(tokens, text_tokens)
    hy = SC.hybrid_importance(tokens, ts, weight)
    t = tokens.join(hy, [G, "token_idx"])
    rows = P._config_rows(configs)
    lv, cfg = P._levels(rows)
    largest = K.largest_group(tokens, [G])
    lt = P._level_tokens(t, lv, score="hybrid_score", largest=largest)
    full = P._full_rows(lt, lv, largest)
    part = lt.where(F.col("keep") < F.col("n"))
    imp = P._important(part)
    rem = part.where(F.col("score_rank") >= F.col("imp")).withColumn("vec", l2_normalise("vec")) \
        .withColumn("k", F.col("div"))
    div = K.run_grouped(rem, [G, "level_id"], lambda m, w, kk: K.text_guided(m, w, kk),
                        cols=("vec", "hybrid_score")).select(
        G, "level_id", "token_idx", F.lit("diverse").alias("stage"), F.col("pick_rank").alias("rank"))
    selected = K.materialise(imp.unionByName(div))
    out = P._finish(selected, None, cfg, full, largest)
    if all(c["recovery_ratio"] <= 0 for c in cfg):
        return out
    ranked = P._recovery(lt, selected, text_tokens, largest).join(F.broadcast(P._cfg_df(lt, cfg)), "level_id")
    ranked = ranked.withColumn("k", P._recover_size())
    cand = K.materialise(ranked.where(F.col("rank") < 2 * F.col("k")).select("config_id", G, "token_idx", "rank", "keep", "k"))
    rows = cand.join(tokens.select(G, "token_idx", l2_normalise("vec").alias("vec")), [G, "token_idx"]) \
        .withColumn("_ord", F.col("rank").cast("bigint")).drop("rank", "keep")
    keys = ["config_id", G]
    picks = K.maxmin(rows, keys, order_col="_ord", largest=largest)
    rec = picks.join(cand.select(*keys, "token_idx", "keep"), [*keys, "token_idx"]).select(
        "config_id", G, "token_idx", F.lit("recovered").alias("stage"), F.col("pick_rank").alias("rank"),
        (F.col("keep") + F.col("pick_rank")).cast("int").alias("position"))
    return out.unionByName(rec)
