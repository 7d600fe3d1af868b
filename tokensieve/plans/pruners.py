"""Token-pruning plans (C1-C7) as DataFrame pipelines over a configuration grid.

Output of every pruner: ``selection(config_id, group_id, token_idx, stage,
rank, position)`` with stage in important | diverse | recovered | summary
| all.

How a sweep is shared (the reference re-runs everything per config):
* scores and the score rank are computed once per group;
* the configuration grid is a checked-size parameter table; the distinct
  keep levels (keep ratio x important ratio x text weight) are exploded
  next to the ranked tokens, so the important top-k and the greedy
  diverse step run once per (group, keep level), not once per config;
* the recovery ranking depends only on the keep level; each recovery
  ratio is a filter ``rank < recover_k`` on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise, uniform
from ..operators import kernels as K
from ..operators import select as S
from ..operators.evaluate import MAX_INLINE_CONFIGS
from ..operators.groupwise import group_softmax, group_stats
from ..operators.scores import mean_vector, query_relevance, question_entropy_scores
from ..operators.tiles import attention_sums
from ..session import written

G = "group_id"
# The reference's pre-sampling threshold and sample factors.
PRESAMPLE_THRESHOLD = None  # no sampling unless the caller asks for it
UNIFORM_FACTOR = 4
WEIGHTED_FACTOR = 3
TEXT_WEIGHT_BASE = 0.7
TEXT_WEIGHT_SLOPE = 0.3

SELECTION_COLS = ("config_id", G, "token_idx", "stage", "rank", "position")


def _config_rows(configs: DataFrame) -> list[dict]:
    """The grid as a list (one small job); its size is checked."""
    rows = configs.limit(MAX_INLINE_CONFIGS + 1).collect()
    if len(rows) > MAX_INLINE_CONFIGS:
        raise ValueError(f"configuration grid has more than {MAX_INLINE_CONFIGS} rows; join it instead")
    return [r.asDict() for r in rows]


def _explode(df: DataFrame, rows: list[dict], fields: dict, alias: str = "_lv") -> DataFrame:
    """Inline a small parameter list next to every row (a Generate, no join)."""
    structs = [F.struct(*[F.lit(r[f]).cast(t).alias(f) for f, t in fields.items()]) for r in rows]
    return df.select("*", F.explode(F.array(*structs)).alias(alias)).select(
        *df.columns, *[F.col(f"{alias}.{f}").alias(f) for f in fields])


def _levels(rows: list[dict]):
    """Distinct keep levels and the configs hanging off each level."""
    levels, cfg = {}, []
    for r in rows:
        key = (r["keep_ratio"], r["important_ratio"], r.get("text_guidance_weight"))
        if key not in levels:
            levels[key] = len(levels)
        cfg.append({"config_id": r["config_id"], "level_id": levels[key], "recovery_ratio": r["recovery_ratio"]})
    lv = [{"level_id": i, "keep_ratio": k[0], "important_ratio": k[1],
           "text_guidance_weight": k[2] if k[2] is not None else 0.0} for k, i in levels.items()]
    return lv, cfg


def _budget(df: DataFrame) -> DataFrame:
    keep = F.least((F.col("keep_ratio") * F.col("n")).cast("int"), F.col("n").cast("int"))
    imp = (keep * F.col("important_ratio")).cast("int")
    return df.withColumn("keep", keep).withColumn("imp", imp).withColumn("div", keep - imp)


def _sized(tokens: DataFrame, largest: int | None) -> DataFrame:
    return group_stats(tokens, G, largest, n=F.count(F.lit(1))).withColumn("n", F.col("n").cast("int"))


def _recover_size() -> Column:
    """Tokens to recover: the ratio of the group, at most those not kept."""
    return F.greatest(F.least((F.col("recovery_ratio") * F.col("n")).cast("int"), F.col("n") - F.col("keep")), F.lit(0))


def _finish(selected_by_level: DataFrame, recovery_by_level: DataFrame | None, cfg: list[dict],
            full_by_level: DataFrame, largest: int | None = None) -> DataFrame:
    """Level results -> per-config selection rows."""
    def per_config(df):
        return df.join(F.broadcast(_cfg_df(df, cfg)), "level_id")

    sel = S.sort_selected(selected_by_level, [G, "level_id"], largest)
    out = per_config(sel).select(*SELECTION_COLS)
    if full_by_level is not None:
        out = out.unionByName(per_config(full_by_level).select(*SELECTION_COLS))
    if recovery_by_level is not None:
        rec = per_config(recovery_by_level)
        rec = rec.where(F.col("rank") < _recover_size()).withColumn("position", (F.col("keep") + F.col("rank")).cast("int"))
        out = out.unionByName(rec.select(*SELECTION_COLS))
    return out


def _cfg_df(df: DataFrame, cfg: list[dict]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(c["config_id"], c["level_id"], float(c["recovery_ratio"])) for c in cfg],
                                 "config_id int, level_id int, recovery_ratio double")


def _level_tokens(tokens: DataFrame, lv: list[dict], score: str = "cls_score",
                  largest: int | None = None) -> DataFrame:
    t = S.rank_desc(_sized(tokens, largest), G, score, "score_rank", largest)
    t = _explode(t, lv, {"level_id": "int", "keep_ratio": "double", "important_ratio": "double",
                         "text_guidance_weight": "double"})
    return _budget(t)


def _full_rows(t: DataFrame, lv: list[dict], largest: int | None = None) -> DataFrame | None:
    """Early exit: keep >= n -> every token, in order, no recovery (only
    possible for a keep ratio >= 1, so otherwise not planned)."""
    if all(level["keep_ratio"] < 1.0 for level in lv):
        return None
    f = t.where(F.col("keep") >= F.col("n"))
    return S.sort_selected(f, [G, "level_id"], largest).select(
        G, "level_id", "token_idx", F.lit("all").alias("stage"), F.col("position").alias("rank"), "position")


def _important(part: DataFrame) -> DataFrame:
    return part.where(F.col("score_rank") < F.col("imp")).select(
        G, "level_id", "token_idx", F.lit("important").alias("stage"), F.col("score_rank").alias("rank"))


def _diverse_maxmin(rem: DataFrame, threshold: int | None, seed: int, sample: str, start: str,
                    max_group: int, largest: int | None = None) -> DataFrame:
    """Max-min over all remaining tokens. Only with a ``threshold`` the V8 rule
    holds: above that many remaining tokens, sample first (uniform
    4x / weighted 3x) and run max-min among the sample (in sample order);
    otherwise max-min over all remaining tokens (index order).  (``remaining
    <= diverse`` only happens when keep >= n, handled as keep-all.)  A
    branch that cannot occur for the largest group is not planned."""
    keys = [G, "level_id"]
    rem = rem.withColumn("_rn", F.col("n") - F.col("imp"))
    cand = rem.where(F.col("_rn") > F.col("div")).withColumn("vec", l2_normalise("vec"))
    parts = []
    if threshold is not None and (largest is None or largest > threshold):
        big = cand.where(F.col("_rn") > threshold)
        factor = UNIFORM_FACTOR if sample == "uniform" else WEIGHTED_FACTOR
        big = big.withColumn("_m", F.least(F.col("div") * factor, F.col("_rn")))
        if sample == "uniform":
            big = S.uniform_sample(big, keys, "_m", seed, "_ord", largest)
        else:
            big = S.weighted_sample(big.withColumn("_w", F.lit(1.0)), keys, "_w", "_m", seed, "_ord",
                                    largest).drop("_w")
        big = big.withColumn("k", F.least(F.col("div"), F.col("_m"))).withColumn("_ord", F.col("_ord").cast("bigint"))
        parts.append(big.select(*keys, "token_idx", "vec", "k", "_ord"))
    small = cand.where(F.col("_rn") <= threshold) if parts else cand
    small = small.withColumn("_ord", F.col("token_idx").cast("bigint")).withColumn("k", F.col("div"))
    parts.append(small.select(*keys, "token_idx", "vec", "k", "_ord"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if start == "seeded":
        both = both.withColumn("_u", uniform(seed + 1, *[F.col(c) for c in keys], F.col("token_idx")))
    picks = K.maxmin(both, keys, "_u" if start == "seeded" else None, "_ord", max_group, largest)
    return picks.select(G, "level_id", "token_idx", F.lit("diverse").alias("stage"), F.col("pick_rank").alias("rank"))


def _recovery(level_tokens: DataFrame, selected: DataFrame, text_tokens: DataFrame,
              largest: int | None = None) -> DataFrame:
    """W13 on the pruned tokens of each (group, level)."""
    part = level_tokens.where(F.col("keep") < F.col("n"))
    pruned = part.join(selected.select(G, "level_id", "token_idx"), [G, "level_id", "token_idx"], "left_anti")
    return _recover_ranked(pruned, text_tokens, largest).select(
        G, "level_id", "token_idx", F.lit("recovered").alias("stage"), "rank", "n", "keep")


def _recover_ranked(pruned: DataFrame, text_tokens: DataFrame, largest: int | None = None) -> DataFrame:
    keys = [G, "level_id"]
    sc = S.recovery_scores(pruned, text_tokens, keys, G, carry=("n", "keep"))
    return S.rank_desc(sc, keys, "recovery_score", "rank", largest)


# C1
def prune_attention_diverse(tokens: DataFrame, text_tokens: DataFrame, configs: DataFrame,
                            presample_threshold: int | None = PRESAMPLE_THRESHOLD, seed: int = 42,
                            max_group: int = K.MAX_GROUP) -> DataFrame:
    """Important top-k by CLS score, max-min diverse fill (V8 rule),
    text-attention recovery (W13) appended after the sorted selection."""
    rows = _config_rows(configs)
    lv, cfg = _levels(rows)
    largest = K.largest_group(tokens, [G])
    t = _level_tokens(tokens, lv, largest=largest)
    full = _full_rows(t, lv, largest)
    part = t.where(F.col("keep") < F.col("n"))
    imp = _important(part)
    rem = part.where(F.col("score_rank") >= F.col("imp"))
    div = _diverse_maxmin(rem, presample_threshold, seed, "uniform", "first", max_group, largest)
    selected = K.materialise(imp.unionByName(div))
    rec = _recovery(t, selected, text_tokens, largest) if any(c["recovery_ratio"] > 0 for c in cfg) else None
    return _finish(selected, rec, cfg, full, largest)


# C2
def prune_attention_textweighted(tokens: DataFrame, text_tokens: DataFrame, configs: DataFrame,
                                 presample_threshold: int | None = PRESAMPLE_THRESHOLD, seed: int = 42,
                                 text_scores: DataFrame | None = None, seeded_start: bool = False) -> DataFrame:
    """As C1, but with a text weight > 0 the diverse fill is text-guided:
    weights ``0.7 + 0.3 * text_score`` (text score 1.0 unless given, as in
    the reference); above the threshold a weighted 3x sample then max-min."""
    rows = _config_rows(configs)
    lv, cfg = _levels(rows)
    largest = K.largest_group(tokens, [G])
    t = _level_tokens(tokens, lv, largest=largest)
    full = _full_rows(t, lv, largest)
    part = t.where(F.col("keep") < F.col("n"))
    imp = _important(part)
    rem = part.where(F.col("score_rank") >= F.col("imp"))
    guided = F.col("text_guidance_weight") > 0
    parts = [imp]
    if any(level["text_guidance_weight"] <= 0 for level in lv):
        parts.append(_diverse_maxmin(rem.where(~guided), presample_threshold, seed, "uniform",
                                     "seeded" if seeded_start else "first", K.MAX_GROUP, largest))
    if any(level["text_guidance_weight"] > 0 for level in lv):
        g = rem.where(guided).withColumn("_rn", F.col("n") - F.col("imp"))
        if text_scores is not None:
            g = g.join(text_scores.select(G, "token_idx", "text_score"), [G, "token_idx"], "left")
            ts = F.coalesce(F.col("text_score"), F.lit(1.0))
        else:
            ts = F.lit(1.0)
        g = g.withColumn("weight", F.lit(TEXT_WEIGHT_BASE) + F.lit(TEXT_WEIGHT_SLOPE) * ts)
        if presample_threshold is not None and largest > presample_threshold:
            g_big = g.where((F.col("_rn") > F.col("div")) & (F.col("_rn") > presample_threshold))
            parts.append(_diverse_maxmin(g_big.drop("_rn", "weight"), presample_threshold, seed, "weighted",
                                         "seeded" if seeded_start else "first", K.MAX_GROUP, largest))
            g = g.where(F.col("_rn") <= presample_threshold)
        g_small = g.where(F.col("_rn") > F.col("div")).withColumn("vec", l2_normalise("vec")) \
            .withColumn("k", F.col("div"))
        parts.append(K.run_grouped(g_small, [G, "level_id"], lambda m, w, kk: K.text_guided(m, w, kk),
                                   cols=("vec", "weight")).select(
            G, "level_id", "token_idx", F.lit("diverse").alias("stage"), F.col("pick_rank").alias("rank")))
    selected = parts[0]
    for p_ in parts[1:]:
        selected = selected.unionByName(p_)
    selected = K.materialise(selected)
    rec = _recovery(t, selected, text_tokens, largest) if any(c["recovery_ratio"] > 0 for c in cfg) else None
    return _finish(selected, rec, cfg, full, largest)


# V14
def fuse_queries(text_tokens: DataFrame) -> DataFrame:
    """Fuse a group's question vectors into one: each attends to all of them,
    ``softmax(q.k / sqrt(d))`` over the group, and the attended vectors are averaged.

    The reference's projections are untrained random weights and are left out. The
    attention that a vector gets from all questions together is its weight in the
    mean, so tiles of the question matrix and one weighted sum are all there is."""
    own = written(text_tokens.select(G, "t_idx", "vec"), "question-vectors")
    scaled = own.select(G, "t_idx", F.transform("vec", lambda x: x / F.sqrt(F.size("vec").cast("double"))).alias("vec"))
    weight = attention_sums(own.withColumnRenamed("t_idx", "token_idx"), scaled, [G])
    weight = weight.select(G, F.col("token_idx").alias("t_idx"), (F.col("attention") / F.col("n_questions")).alias("_w"))
    weighted = own.join(weight, [G, "t_idx"]).select(G, "_w", F.posexplode("vec").alias("_p", "_x"))
    summed = weighted.groupBy(G, "_p").agg(F.sum(F.col("_x") * F.col("_w")).alias("_v"))
    return written(summed.groupBy(G).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias("fused")), "fused-questions")


# C4
def prune_multi_query(tokens: DataFrame, text_tokens: DataFrame, configs: DataFrame, seed: int = 42) -> DataFrame:
    """Important top-k by CLS; remaining scored ``w*softmax(fused.token) +
    (1-w)*cls``; weighted 3x sample, first ``diverse`` of it; recovery by
    ``w*softmax(text) + (1-w)*softmax(cls)`` (CLS only without questions)."""
    rows = _config_rows(configs)
    lv, cfg = _levels(rows)
    largest = K.largest_group(tokens, [G])
    t = _level_tokens(tokens, lv, largest=largest)
    full = _full_rows(t, lv, largest)
    part = t.where(F.col("keep") < F.col("n"))
    imp = _important(part)
    fused = fuse_queries(text_tokens)
    rem = part.where(F.col("score_rank") >= F.col("imp")).join(fused, G, "left")
    rem = rem.withColumn("_ts", F.when(F.col("fused").isNotNull(), dot("fused", "vec")))
    rem_t = group_softmax(rem, [G, "level_id"], "_ts", "_pt", largest)   # null for groups without questions
    w = F.col("text_guidance_weight")
    rem_t = rem_t.withColumn("_final", F.when(F.col("_pt").isNotNull(),
                                              w * F.col("_pt") + (F.lit(1.0) - w) * F.col("cls_score"))
                             .otherwise(F.col("cls_score")))
    # (remaining <= diverse only when keep >= n, handled as keep-all)
    samp = S.weighted_sample(rem_t, [G, "level_id"], "_final", "div", seed, "rank", largest)
    div = samp.select(G, "level_id", "token_idx", F.lit("diverse").alias("stage"), "rank")
    selected = imp.unionByName(div)
    # recovery
    pruned = part.join(selected.select(G, "level_id", "token_idx"), [G, "level_id", "token_idx"], "left_anti") \
        .join(fused, G, "left")
    with_q = pruned.where(F.col("fused").isNotNull()).withColumn("_a", dot("fused", "vec"))
    with_q = group_softmax(with_q, [G, "level_id"], "_a", "_pt", largest)
    with_q = group_softmax(with_q, [G, "level_id"], "cls_score", "_pc", largest)
    with_q = with_q.withColumn("_score", w * F.col("_pt") + (F.lit(1.0) - w) * F.col("_pc"))
    no_q = pruned.where(F.col("fused").isNull()).withColumn("_score", F.col("cls_score"))
    sc = with_q.select(G, "level_id", "token_idx", "_score", "n", "keep").unionByName(
        no_q.select(G, "level_id", "token_idx", "_score", "n", "keep"))
    rec = S.rank_desc(sc, [G, "level_id"], "_score", "rank", largest).select(
        G, "level_id", "token_idx", F.lit("recovered").alias("stage"), "rank", "n", "keep")
    return _finish(selected, rec, cfg, full, largest)


# C5
def prune_dpp(tokens: DataFrame, text_tokens: DataFrame, configs: DataFrame,
              max_group: int = K.MAX_GROUP) -> DataFrame:
    """Relevance ``-mean cos(token, question)`` min-max scaled (A22),
    greedy DPP MAP of ``keep`` tokens (V13), output in token order."""
    rows = _config_rows(configs)
    lv, cfg = _levels(rows)
    rel = query_relevance(tokens, text_tokens)
    largest = K.largest_group(tokens, [G])
    t = _sized(tokens, largest).join(rel, [G, "token_idx"])
    t = _budget(_explode(t, lv, {"level_id": "int", "keep_ratio": "double", "important_ratio": "double",
                                 "text_guidance_weight": "double"}))
    full = _full_rows(t, lv, largest)
    part = t.where(F.col("keep") < F.col("n"))
    picks = K.dpp_select(part.select(G, "level_id", "token_idx", "vec", "relevance", F.col("keep").alias("kk")),
                         [G, "level_id"], "kk", max_group=max_group, largest=largest)
    selected = picks.select(G, "level_id", "token_idx", F.lit("dpp").alias("stage"), F.col("pick_rank").alias("rank"))
    return _finish(selected, None, cfg, full, largest)


# C6
def prune_entropy(tokens: DataFrame, text_tokens: DataFrame, configs: DataFrame, lam: float = 0.1) -> DataFrame:
    """Attention = softmax over tokens of question.token; entropy scores
    (W9); top-keep in score order; one summary token = mean of all pruned
    tokens (A20, its vector in ``summary_vec``); recovery by attention summed
    over questions (W14)."""
    rows = _config_rows(configs)
    lv, cfg = _levels(rows)
    es = question_entropy_scores(tokens, text_tokens, lam)
    largest = K.largest_group(tokens, [G])
    t = _sized(tokens, largest).join(es, [G, "token_idx"])
    t = S.rank_desc(t, G, "entropy_score", "score_rank", largest)
    t = _explode(t, lv, {"level_id": "int", "keep_ratio": "double", "important_ratio": "double",
                         "text_guidance_weight": "double"})
    t = _budget(t)
    top = t.where(F.col("score_rank") < F.col("keep"))
    pruned = t.where(F.col("score_rank") >= F.col("keep"))
    summary = mean_vector(pruned.select(G, "level_id", "vec"), [G, "level_id"], "vec", "mean_vec")
    att_sum = pruned.select(G, "level_id", "token_idx", "n", "keep", F.col("attention").alias("recovery_score"))
    rec = S.rank_desc(att_sum, [G, "level_id"], "recovery_score", "rank", largest)
    per_cfg = F.broadcast(_cfg_df(t, cfg))
    no_vec = F.lit(None).cast("array<double>").alias("summary_vec")
    sel = top.join(per_cfg, "level_id").select(
        "config_id", G, "token_idx", F.lit("important").alias("stage"), F.col("score_rank").alias("rank"),
        F.col("score_rank").alias("position"), no_vec)
    summ = summary.join(t.select(G, "level_id", "keep").distinct(), [G, "level_id"]).join(per_cfg, "level_id").select(
        "config_id", G, F.lit(None).cast("bigint").alias("token_idx"), F.lit("summary").alias("stage"),
        F.lit(0).alias("rank"), F.col("keep").alias("position"), F.col("mean_vec").alias("summary_vec"))
    r = rec.join(per_cfg, "level_id").where(F.col("rank") < _recover_size()).select(
        "config_id", G, "token_idx", F.lit("recovered").alias("stage"), "rank",
        (F.col("keep") + 1 + F.col("rank")).cast("int").alias("position"), no_vec)
    return sel.unionByName(summ).unionByName(r)


# C7
def no_prune(tokens: DataFrame, configs: DataFrame) -> DataFrame:
    """Baseline arm: every token, in order, for every configuration."""
    rows = _config_rows(configs)
    t = S.sort_selected(tokens, G)
    t = _explode(t, rows, {"config_id": "int"})
    return t.select("config_id", G, "token_idx", F.lit("all").alias("stage"), F.col("position").alias("rank"),
                    "position")
