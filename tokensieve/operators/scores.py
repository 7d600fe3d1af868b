"""Per-group scores over token tables.

Group statistics (min, max, sums) are partial aggregates, one small state a
group, joined back to the rows: no window, so a hot group is never gathered
in one task. The rows are written once where they come from more than a scan,
so that a chain of such steps does not repeat the plan above it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise
from ..session import written
from .numbering import number_in_groups
from .tiles import attention_entropy, attention_sums, largest_similarity, similarity_rows

# Guards used by the reference's score formulas.
MINMAX_EPS = 1e-8
ENTROPY_EPS = 1e-10
RELEVANCE_EPS = 1e-6


def join_group_stats(df: DataFrame, keys, **aggs: Column) -> DataFrame:
    """Attach per-group aggregates ``name=expr`` to every row of the group. A null key is a group too."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    states = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[a.alias(n) for n, a in aggs.items()])
    return _joined_states(df, states, keys)


def _joined_states(df: DataFrame, states: DataFrame, keys) -> DataFrame:
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(states, same).drop(*[f"_k{i}" for i in range(len(keys))])


# W2
def minmax_norm(df: DataFrame, keys, col: str, out: str, eps: float = MINMAX_EPS) -> DataFrame:
    s = join_group_stats(df, keys, _mn=F.min(col), _mx=F.max(col))
    return s.withColumn(out, (F.col(col) - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + F.lit(eps))) \
        .drop("_mn", "_mx")


# W3
def softmax(df: DataFrame, keys, col: str, out: str) -> DataFrame:
    """Stable softmax of ``col`` inside each group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    df = written(df, "softmax-rows")
    top = join_group_stats(df.select(*keys, F.col(col).alias("_v")), keys, _mx=F.max("_v"))
    states = top.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_mx").agg(F.sum(F.exp(F.col("_v") - F.col("_mx"))).alias("_se"))
    return _joined_states(df, states, keys).withColumn(out, F.exp(F.col(col) - F.col("_mx")) / F.col("_se")).drop("_mx", "_se")


# J7
def text_image_similarity(tokens: DataFrame, text_tokens: DataFrame, normalise: bool = False) -> DataFrame:
    """Every question vector x every token of the same group: (group, t_idx, token_idx, sim),
    computed in tiles of a bounded number of tokens and question vectors."""
    if normalise:
        tokens, text_tokens = (d.withColumn("vec", l2_normalise("vec")) for d in (tokens, text_tokens))
    return similarity_rows(tokens, text_tokens, ["group_id"])


# A21
def max_pool_similarity(tokens: DataFrame, text_tokens: DataFrame) -> DataFrame:
    """The largest similarity of a token to a question vector of its group, from tile maxima."""
    return largest_similarity(tokens, text_tokens, ["group_id"])


# A22
def query_relevance(tokens: DataFrame, text_tokens: DataFrame) -> DataFrame:
    """``-mean_t cos(token, text)``, then ``(x - min + 1e-6) / (max - min)`` per group.

    The mean of the cosines is the token's product with the mean of the
    normalised question vectors, so no pair of the two is ever formed."""
    mean = mean_vector(text_tokens.select("group_id", l2_normalise("vec").alias("vec")), "group_id", "vec", "_mq")
    rel = tokens.join(mean, "group_id").select("group_id", "token_idx", (-dot(l2_normalise("vec"), "_mq")).alias("_r"))
    s = join_group_stats(rel, "group_id", _mn=F.min("_r"), _mx=F.max("_r"))
    return s.select("group_id", "token_idx",
                    ((F.col("_r") - F.col("_mn") + F.lit(RELEVANCE_EPS))
                     / F.nullif(F.col("_mx") - F.col("_mn"), F.lit(0.0))).alias("relevance"))


# A18
def head_mean_attention(attention: DataFrame) -> DataFrame:
    """Penultimate layer (last if only one), CLS query row, CLS column
    dropped, mean over heads -> (group_id, token_pos, cls_score)."""
    layers = attention.groupBy("group_id").agg(F.max("layer").alias("_L"), F.min("layer").alias("_l0"))
    a = attention.join(layers, "group_id")
    pick = F.when(F.col("_L") > F.col("_l0"), F.col("_L") - 1).otherwise(F.col("_L"))
    a = a.where((F.col("layer") == pick) & (F.col("q_pos") == 0) & (F.col("k_pos") > 0))
    return a.groupBy("group_id", F.col("k_pos").alias("token_pos")).agg(F.avg("w").alias("cls_score"))


# A19
def layer_patch_select(features: DataFrame, strategy: str = "patch") -> DataFrame:
    """Second-to-last layer; ``patch`` drops position 0, ``cls_patch`` keeps it."""
    if strategy not in ("patch", "cls_patch"):
        raise ValueError(f"Unexpected select feature: {strategy}")
    layers = features.groupBy("group_id").agg(F.max("layer").alias("_L"))
    f = features.join(layers, "group_id").where(F.col("layer") == F.col("_L") - 1)
    if strategy == "patch":
        f = f.where(F.col("pos") > 0)
    return f.drop("_L")


# A20
def mean_vector(df: DataFrame, keys, vec: str = "vec", out: str = "mean_vec") -> DataFrame:
    """Element-wise mean of each group's vectors (partial aggregation per
    element position; no per-group array is collected)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ex = df.select(*keys, F.posexplode(vec).alias("_p", "_x"))
    per = ex.groupBy(*keys, "_p").agg(F.avg("_x").alias("_m"))
    return per.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(out))


# W4 / W5 / W6 / W7
def adaptive_keep_ratio(scores: DataFrame, col: str = "cls_score", base: float = 0.125) -> DataFrame:
    """Elbow, statistical and 80 %-importance ratios, their lower median with
    the base ratio, clamped to [0.05, 0.8] (one row per group).

    Positions and running sums come from ranges of the sorted scores
    (``number_in_groups``), and the next two scores by position, so a group
    of any size is spread over many tasks; the rest are plain aggregates.
    """
    s = scores.select("group_id", "token_idx", F.col(col).alias("s"))
    s = written(number_in_groups(s, ["group_id"], [F.desc("s"), F.asc("token_idx")], "s", "_pos", "_cum"), "sorted-scores")
    ahead = s.select("group_id", F.explode(F.array(*[F.struct((F.col("_pos") - i).alias("_pos"), F.lit(i).alias("i"), F.col("s").alias("v")) for i in range(3)])).alias("x"))
    at = lambda i: F.max(F.when(F.col("x.i") == i, F.col("x.v")))
    bends = ahead.groupBy("group_id", F.col("x._pos").alias("_pos")).agg((at(0) - 2 * at(1) + at(2)).alias("_d2")).where("_d2 is not null")
    bend = bends.groupBy("group_id").agg(F.min_by("_pos", F.struct(-F.col("_d2"), F.col("_pos"))).alias("_arg"), F.max("_d2").alias("_d2max"))
    g = s.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("_mean"), F.stddev_samp("s").alias("_std"), F.sum("s").alias("_tot"))
    counts = s.join(g, "group_id").groupBy("group_id").agg(
        F.first("n").alias("n"),
        F.count_if(F.col("s") > F.col("_mean") + 0.5 * F.col("_std")).alias("_sig"),
        F.count_if(F.col("_cum") <= 0.8 * F.col("_tot")).alias("_imp"),
    )
    c = counts.join(bend, "group_id", "left")
    n = F.col("n").cast("double")
    elbow = F.when((F.col("n") > 3) & F.col("_d2max").isNotNull(), (F.col("_arg") + 2) / n).otherwise(F.lit(base))
    stat = F.col("_sig") / n
    imp = (F.col("_imp") + 1) / n
    med = F.sort_array(F.array(elbow, stat, imp, F.lit(base)))[1]
    return c.select("group_id", F.round(elbow, 9).alias("elbow_ratio"), F.round(stat, 9).alias("statistical_ratio"),
                    F.round(imp, 9).alias("importance_ratio"),
                    F.round(F.least(F.greatest(med, F.lit(0.05)), F.lit(0.8)), 9).alias("keep_ratio"))


# W8
def entropy_keep_ratio(scores: DataFrame, col: str = "cls_score", base: float = 0.125) -> DataFrame:
    """Normalised softmax entropy -> x0.7 below 0.3, x1.3 above 0.8, clamp
    [0.05, 0.5]; the base ratio when a score is NaN/inf or all are equal."""
    first = scores.groupBy("group_id").agg(F.min_by(col, "token_idx").alias("_s0"))
    s = scores.join(first, "group_id")
    sm = softmax(s, "group_id", col, "_p")
    sm = sm.withColumn("_pc", F.least(F.greatest(F.col("_p"), F.lit(ENTROPY_EPS)), F.lit(1.0)))
    g = sm.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"),
        (-F.sum(F.col("_pc") * F.log(F.col("_pc")))).alias("_h"),
        F.count_if(F.isnan(col) | (F.abs(col) == F.lit(float("inf")))).alias("_bad"),
        F.count_if(F.abs(F.col(col) - F.col("_s0")) > F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("_s0"))).alias("_diff"),
    )
    hn = F.col("_h") / F.log(F.col("n").cast("double"))
    adj = F.when(hn < 0.3, F.lit(base * 0.7)).when(hn > 0.8, F.lit(base * 1.3)).otherwise(F.lit(base))
    ratio = F.when((F.col("_bad") > 0) | (F.col("_diff") == 0), F.lit(base)).otherwise(
        F.least(F.greatest(adj, F.lit(0.05)), F.lit(0.5)))
    return g.select("group_id", F.round(F.when(F.col("_diff") > 0, hn), 9).alias("normalized_entropy"),
                    F.round(ratio, 9).alias("keep_ratio"))


# W9
def entropy_scores(attn: DataFrame, lam: float = 0.1) -> DataFrame:
    """Attention (group, t_idx, token_idx, a), as given: normalise each token column
    over the text rows, entropy per token, score = -lambda * H."""
    s = join_group_stats(attn, ["group_id", "token_idx"], _cs=F.sum("a"))
    p = F.greatest(F.col("a") / (F.col("_cs") + F.lit(ENTROPY_EPS)), F.lit(ENTROPY_EPS))
    h = s.groupBy("group_id", "token_idx").agg((-F.sum(p * F.log(p))).alias("_h"))
    return h.select("group_id", "token_idx", (F.lit(-lam) * F.col("_h")).alias("entropy_score"))


def question_entropy_scores(tokens: DataFrame, text_tokens: DataFrame, lam: float = 0.1) -> DataFrame:
    """W9 where the attention of a question vector is the softmax over the tokens of
    its group: computed in tiles, no attention row is made. Also the token's summed ``attention``."""
    h = attention_entropy(tokens, text_tokens, ["group_id"])
    return h.select("group_id", "token_idx", (F.lit(-lam) * F.col("entropy")).alias("entropy_score"), "attention")


# W10
def _headmean(mean: DataFrame, lam: float) -> DataFrame:
    s = join_group_stats(mean, "group_id", _t=F.sum("_m"))
    p = F.greatest(F.col("_m") / (F.col("_t") + F.lit(ENTROPY_EPS)), F.lit(ENTROPY_EPS))
    return s.groupBy("group_id").agg((F.lit(-lam) * -F.sum(p * F.log(p))).alias("entropy_score"))


def entropy_scores_headmean(attn: DataFrame, lam: float = 0.1) -> DataFrame:
    """Average the rows first, then one entropy over the tokens: a single
    scalar per group."""
    return _headmean(attn.groupBy("group_id", "token_idx").agg(F.avg("a").alias("_m")), lam)


def question_entropy_headmean(tokens: DataFrame, text_tokens: DataFrame, lam: float = 0.1) -> DataFrame:
    """W10 of the question vectors' attention, computed in tiles."""
    sums = attention_sums(tokens, text_tokens, ["group_id"])
    return _headmean(written(sums.select("group_id", (F.col("attention") / F.col("n_questions")).alias("_m")), "mean-attention"), lam)


# W11
def hybrid_importance(cls: DataFrame, text: DataFrame, weight: float = 0.5) -> DataFrame:
    """``(1-w) * minmax(cls) + w * minmax(text)`` per token."""
    a = minmax_norm(cls.select("group_id", "token_idx", "cls_score"), "group_id", "cls_score", "_c")
    b = minmax_norm(text.select("group_id", "token_idx", "text_score"), "group_id", "text_score", "_t")
    j = a.join(b, ["group_id", "token_idx"])
    return j.select("group_id", "token_idx",
                    (F.lit(1 - weight) * F.col("_c") + F.lit(weight) * F.col("_t")).alias("hybrid_score"))


# W12
def combined_guidance_score(df: DataFrame, keys, text_col: str, cls_col: str, weight,
                            soften_cls: bool = False) -> DataFrame:
    """``w * softmax(text) + (1-w) * cls`` (selection) or with ``softmax(cls)``
    (recovery) inside each group."""
    t = softmax(df, keys, text_col, "_pt")
    c = softmax(t, keys, cls_col, "_pc") if soften_cls else t.withColumn("_pc", F.col(cls_col))
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else F.col(weight)
    return c.withColumn("guidance_score", w * F.col("_pt") + (F.lit(1.0) - w) * F.col("_pc")).drop("_pt", "_pc")
