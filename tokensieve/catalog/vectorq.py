"""Registered queries: vector functions, per-group scores, windows,
samples, set operations (exact DuckDB twins) and greedy kernels
(rows-only for the driver; NumPy brute force in tests/)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import kernels as K
from ..operators import scores as SC
from ..operators import select as S
from ..operators.tiles import attention_sums
from ..plans import pruners as P
from ..sources import tables as tb
from .sqlbits import duckdb_with

QUERIES: dict = {}
SQL: dict = {}
G = "group_id"


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def r9(c):
    return F.round(c, 9)


def arr6(c):
    return F.transform(c, lambda x: F.round(x, 6))


_T = duckdb_with("tokens", "text_tokens")
NORM = "list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12))"


# ------------------------------------------------------------------ V1
@register("l2_normalise", _T + f"""
SELECT group_id, token_idx, list_transform({NORM}, lambda x: round(x, 6)) AS vec FROM tokens""")
def q_l2_normalise(spark, sf):
    t = tb.tokens(spark, sf)
    return t.select(G, "token_idx", arr6(V.l2_normalise("vec")).alias("vec"))


# ------------------------------------------------------------------ J7
@register("text_image_similarity", _T + """
SELECT k.group_id, t.t_idx, k.token_idx, round(list_dot_product(k.vec, t.vec), 6) AS sim
FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id""")
def q_text_image_similarity(spark, sf):
    s = SC.text_image_similarity(tb.tokens(spark, sf), tb.text_tokens(spark, sf))
    return s.select(G, "t_idx", "token_idx", r6(F.col("sim")).alias("sim"))


# ------------------------------------------------------------------ A21
@register("max_pool_similarity", _T + """
SELECT k.group_id, k.token_idx, round(max(list_dot_product(k.vec, t.vec)), 6) AS text_score
FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id GROUP BY ALL""")
def q_max_pool_similarity(spark, sf):
    s = SC.max_pool_similarity(tb.tokens(spark, sf), tb.text_tokens(spark, sf))
    return s.select(G, "token_idx", r6(F.col("text_score")).alias("text_score"))


# ------------------------------------------------------------------ A22
_TN = NORM.replace("vec", "t.vec")
_KN = NORM.replace("vec", "k.vec")


@register("query_relevance", _T + f"""
, r AS (SELECT k.group_id, k.token_idx, -avg(list_dot_product({_KN}, {_TN})) AS r
        FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id GROUP BY ALL)
SELECT group_id, token_idx,
       round((r - min(r) OVER (PARTITION BY group_id) + 1e-6) /
             (max(r) OVER (PARTITION BY group_id) - min(r) OVER (PARTITION BY group_id)), 6) AS relevance FROM r""")
def q_query_relevance(spark, sf):
    r = SC.query_relevance(tb.tokens(spark, sf), tb.text_tokens(spark, sf))
    return r.select(G, "token_idx", r6(F.col("relevance")).alias("relevance"))


# ------------------------------------------------------------------ J6 (a row for each pair, with its token's summary)
@register("pairwise_similarity", _T + f"""
, n AS (SELECT group_id, token_idx, {NORM} AS v FROM tokens)
SELECT a.group_id, a.token_idx, b.token_idx AS other_idx, round(list_dot_product(a.v, b.v), 6) AS sim,
       round(max(list_dot_product(a.v, b.v)) OVER w, 6) AS max_sim, round(avg(list_dot_product(a.v, b.v)) OVER w, 6) AS mean_sim
FROM n a JOIN n b ON a.group_id = b.group_id AND a.token_idx <> b.token_idx WINDOW w AS (PARTITION BY a.group_id, a.token_idx)""")
def q_pairwise_similarity(spark, sf):
    t = tb.tokens(spark, sf)
    s = K.pairwise_summary(t, [G]).select(G, "token_idx", r6(F.col("max_sim")).alias("max_sim"), r6(F.col("mean_sim")).alias("mean_sim"))
    return K.pairwise_rows(t, s, [G]).select(G, "token_idx", "other_idx", r6(F.col("sim")).alias("sim"), "max_sim", "mean_sim")


# ------------------------------------------------------------------ attention / features fixtures
# (layer, head, q) combinations of the attention fixture: 3 layers x 2 heads x 2 query rows
_COMBOS = [(lay, h, q) for lay in range(3) for h in range(2) for q in range(2)]


def attention_view(spark, sf):
    """attention(group_id, layer, head, q_pos, k_pos, w) derived from tokens:
    k_pos 0 is the CLS column (w = 1), token columns start at 1."""
    t = tb.tokens(spark, sf)
    combos = F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("head"), F.lit(c).alias("q_pos"))
                       for a, b, c in _COMBOS])
    x = t.select(G, "token_idx", "vec", F.explode(combos).alias("c"))
    rows = x.select(G, F.col("c.layer").alias("layer"), F.col("c.head").alias("head"),
                    F.col("c.q_pos").alias("q_pos"), (F.col("token_idx") + 1).alias("k_pos"),
                    F.abs(F.element_at("vec", (F.col("c.layer") * 4 + F.col("c.head") * 2 + F.col("c.q_pos") + 1)
                                       .cast("int"))).alias("w"))
    cls = t.select(G).distinct().select(G, F.explode(combos).alias("c")).select(
        G, F.col("c.layer").alias("layer"), F.col("c.head").alias("head"), F.col("c.q_pos").alias("q_pos"),
        F.lit(0).cast("bigint").alias("k_pos"), F.lit(1.0).alias("w"))
    return rows.unionByName(cls)


_ATT = """, combos AS (SELECT * FROM (VALUES """ + ", ".join(f"({a},{b},{c})" for a, b, c in _COMBOS) + """) v(layer, head, q_pos)),
attention AS (
  SELECT group_id, layer, head, q_pos, token_idx + 1 AS k_pos, abs(vec[layer * 4 + head * 2 + q_pos + 1]) AS w
  FROM tokens, combos
  UNION ALL
  SELECT group_id, layer, head, q_pos, 0::BIGINT, 1.0::DOUBLE FROM (SELECT DISTINCT group_id FROM tokens), combos)
"""


@register("head_mean_attention", _T + _ATT + """
, L AS (SELECT group_id, max(layer) AS mx, min(layer) AS mn FROM attention GROUP BY 1)
SELECT a.group_id, a.k_pos AS token_pos, round(avg(w), 9) AS cls_score FROM attention a JOIN L USING (group_id)
WHERE a.layer = CASE WHEN mx > mn THEN mx - 1 ELSE mx END AND q_pos = 0 AND k_pos > 0 GROUP BY ALL""")
def q_head_mean_attention(spark, sf):
    h = SC.head_mean_attention(attention_view(spark, sf))
    return h.select(G, "token_pos", r9(F.col("cls_score")).alias("cls_score"))


@register("layer_patch_select", _T + _ATT + """
, feats AS (SELECT DISTINCT group_id, layer, k_pos AS pos FROM attention)
, L AS (SELECT group_id, max(layer) AS mx FROM feats GROUP BY 1)
SELECT f.group_id, f.layer, f.pos FROM feats f JOIN L USING (group_id) WHERE f.layer = mx - 1 AND pos > 0""")
def q_layer_patch_select(spark, sf):
    feats = attention_view(spark, sf).select(G, "layer", F.col("k_pos").alias("pos")).distinct()
    return SC.layer_patch_select(feats, "patch").select(G, "layer", "pos")


# ------------------------------------------------------------------ A20
@register("mean_vector", _T + """
, e AS (SELECT group_id, unnest(vec) AS x, unnest(range(len(vec))) AS p FROM tokens)
, m AS (SELECT group_id, p, avg(x) AS m FROM e GROUP BY ALL)
SELECT group_id, list(round(m, 6) ORDER BY p) AS mean_vec FROM m GROUP BY group_id""")
def q_mean_vector(spark, sf):
    m = SC.mean_vector(tb.tokens(spark, sf), G)
    return m.select(G, arr6(F.col("mean_vec")).alias("mean_vec"))


# ------------------------------------------------------------------ W2 / W3
@register("minmax_norm", _T + """
SELECT group_id, token_idx, round((cls_score - min(cls_score) OVER w) / (max(cls_score) OVER w - min(cls_score) OVER w + 1e-8), 9) AS norm_score
FROM tokens WINDOW w AS (PARTITION BY group_id)""")
def q_minmax_norm(spark, sf):
    m = SC.minmax_norm(tb.tokens(spark, sf), G, "cls_score", "norm_score")
    return m.select(G, "token_idx", r9(F.col("norm_score")).alias("norm_score"))


@register("softmax_in_group", _T + """
SELECT group_id, token_idx, round(exp(cls_score - max(cls_score) OVER w) / sum(exp(cls_score - max(cls_score) OVER w)) OVER w, 9) AS p
FROM tokens WINDOW w AS (PARTITION BY group_id)""".replace(
    "sum(exp(cls_score - max(cls_score) OVER w)) OVER w", "sum(e) OVER w").replace(
    "FROM tokens WINDOW", "FROM (SELECT *, exp(cls_score - max(cls_score) OVER (PARTITION BY group_id)) AS e FROM tokens) WINDOW"))
def q_softmax_in_group(spark, sf):
    s = SC.softmax(tb.tokens(spark, sf), G, "cls_score", "p")
    return s.select(G, "token_idx", r9(F.col("p")).alias("p"))


# ------------------------------------------------------------------ W4-W7
_ADAPT = _T + """
, s AS (SELECT group_id, token_idx, cls_score AS s,
          row_number() OVER w - 1 AS pos,
          sum(cls_score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
          cls_score - 2 * lead(cls_score, 1) OVER w + lead(cls_score, 2) OVER w AS d2
        FROM tokens WINDOW w AS (PARTITION BY group_id ORDER BY cls_score DESC, token_idx))
, g AS (SELECT group_id, count(*) AS n, avg(s) AS mean, stddev_samp(s) AS std, sum(s) AS tot,
          arg_min(pos, (-d2, pos)) FILTER (WHERE d2 IS NOT NULL) AS arg, max(d2) AS d2max FROM s GROUP BY 1)
, c AS (SELECT g.group_id, any_value(n) AS n, any_value(arg) AS arg, any_value(d2max) AS d2max,
          count(*) FILTER (WHERE s > mean + 0.5 * std) AS sig, count(*) FILTER (WHERE cum <= 0.8 * tot) AS imp
        FROM s JOIN g USING (group_id) GROUP BY g.group_id)
, r AS (SELECT group_id,
          CASE WHEN n > 3 AND d2max IS NOT NULL THEN (arg + 2) / n::DOUBLE ELSE 0.125::DOUBLE END AS elbow_ratio,
          sig / n::DOUBLE AS statistical_ratio, (imp + 1) / n::DOUBLE AS importance_ratio FROM c)
"""


def _adapt(spark, sf):
    return SC.adaptive_keep_ratio(tb.tokens(spark, sf))


@register("cumulative_importance", _ADAPT + "SELECT group_id, round(importance_ratio, 9) AS importance_ratio FROM r")
def q_cumulative_importance(spark, sf):
    return _adapt(spark, sf).select(G, "importance_ratio")


@register("elbow_ratio", _ADAPT + "SELECT group_id, round(elbow_ratio, 9) AS elbow_ratio FROM r")
def q_elbow_ratio(spark, sf):
    return _adapt(spark, sf).select(G, "elbow_ratio")


@register("significant_ratio", _ADAPT + "SELECT group_id, round(statistical_ratio, 9) AS statistical_ratio FROM r")
def q_significant_ratio(spark, sf):
    return _adapt(spark, sf).select(G, "statistical_ratio")


@register("adaptive_keep_ratio", _ADAPT + """
SELECT group_id, round(elbow_ratio, 9) AS elbow_ratio, round(statistical_ratio, 9) AS statistical_ratio,
  round(importance_ratio, 9) AS importance_ratio,
  round(least(greatest(list_sort([elbow_ratio, statistical_ratio, importance_ratio, 0.125::DOUBLE])[2], 0.05::DOUBLE), 0.8::DOUBLE), 9) AS keep_ratio
FROM r""")
def q_adaptive_keep_ratio(spark, sf):
    return _adapt(spark, sf)


# ------------------------------------------------------------------ W8
@register("entropy_keep_ratio", _T + """
, f AS (SELECT group_id, arg_min(cls_score, token_idx) AS s0 FROM tokens GROUP BY 1)
, p AS (SELECT t.*, s0, exp(cls_score - max(cls_score) OVER w) AS e FROM tokens t JOIN f USING (group_id)
        WINDOW w AS (PARTITION BY group_id))
, q AS (SELECT *, least(greatest(e / sum(e) OVER (PARTITION BY group_id), 1e-10), 1.0) AS pc FROM p)
, g AS (SELECT group_id, count(*) AS n, -sum(pc * ln(pc)) AS h,
          count(*) FILTER (WHERE isnan(cls_score) OR abs(cls_score) = 'inf'::DOUBLE) AS bad,
          count(*) FILTER (WHERE abs(cls_score - s0) > 1e-8 + 1e-5 * abs(s0)) AS diff FROM q GROUP BY 1)
SELECT group_id, round(CASE WHEN diff > 0 THEN h / ln(n::DOUBLE) END, 9) AS normalized_entropy,
  round(CASE WHEN bad > 0 OR diff = 0 THEN 0.125::DOUBLE ELSE least(greatest(
     CASE WHEN h / ln(n::DOUBLE) < 0.3 THEN (0.125 * 0.7)::DOUBLE WHEN h / ln(n::DOUBLE) > 0.8 THEN (0.125 * 1.3)::DOUBLE ELSE 0.125::DOUBLE END,
     0.05), 0.5) END, 9) AS keep_ratio FROM g""")
def q_entropy_keep_ratio(spark, sf):
    return SC.entropy_keep_ratio(tb.tokens(spark, sf))


# ------------------------------------------------------------------ W9 / W10 / C6 attention
_ATTN = _T + """
, d AS (SELECT k.group_id, t.t_idx, k.token_idx, list_dot_product(k.vec, t.vec) AS d
        FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id)
, e AS (SELECT *, exp(d - max(d) OVER (PARTITION BY group_id, t_idx)) AS e FROM d)
, attn AS (SELECT group_id, t_idx, token_idx, e / sum(e) OVER (PARTITION BY group_id, t_idx) AS a FROM e)
"""


@register("entropy_scores", _ATTN + """
, c AS (SELECT *, greatest(a / (sum(a) OVER (PARTITION BY group_id, token_idx) + 1e-10), 1e-10) AS p FROM attn)
SELECT group_id, token_idx, round(-0.1 * -sum(p * ln(p)), 9) AS entropy_score FROM c GROUP BY ALL""")
def q_entropy_scores(spark, sf):
    e = SC.question_entropy_scores(tb.tokens(spark, sf), tb.text_tokens(spark, sf), 0.1)
    return e.select(G, "token_idx", r9(F.col("entropy_score")).alias("entropy_score"))


@register("entropy_scores_headmean", _ATTN + """
, m AS (SELECT group_id, token_idx, avg(a) AS m FROM attn GROUP BY ALL)
, c AS (SELECT *, greatest(m / (sum(m) OVER (PARTITION BY group_id) + 1e-10), 1e-10) AS p FROM m)
SELECT group_id, round(-0.1 * -sum(p * ln(p)), 9) AS entropy_score FROM c GROUP BY ALL""")
def q_entropy_scores_headmean(spark, sf):
    e = SC.question_entropy_headmean(tb.tokens(spark, sf), tb.text_tokens(spark, sf), 0.1)
    return e.select(G, r9(F.col("entropy_score")).alias("entropy_score"))


# ------------------------------------------------------------------ W11 / W12
_TS = """
, ts AS (SELECT k.group_id, k.token_idx, max(list_dot_product(k.vec, t.vec)) AS text_score
         FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id GROUP BY ALL)
"""


@register("hybrid_importance", _T + _TS + """
, j AS (SELECT k.group_id, k.token_idx, k.cls_score, ts.text_score FROM tokens k JOIN ts USING (group_id, token_idx))
SELECT group_id, token_idx, round(0.5 * (cls_score - min(cls_score) OVER w) / (max(cls_score) OVER w - min(cls_score) OVER w + 1e-8)
   + 0.5 * (text_score - min(text_score) OVER w) / (max(text_score) OVER w - min(text_score) OVER w + 1e-8), 9) AS hybrid_score
FROM j WINDOW w AS (PARTITION BY group_id)""")
def q_hybrid_importance(spark, sf):
    t = tb.tokens(spark, sf)
    ts = SC.max_pool_similarity(t, tb.text_tokens(spark, sf))
    h = SC.hybrid_importance(t, ts, 0.5)
    return h.select(G, "token_idx", r9(F.col("hybrid_score")).alias("hybrid_score"))


@register("combined_guidance_score", _T + _TS + """
, j AS (SELECT k.group_id, k.token_idx, k.cls_score, ts.text_score,
          exp(ts.text_score - max(ts.text_score) OVER w) AS et, exp(k.cls_score - max(k.cls_score) OVER w) AS ec
        FROM tokens k JOIN ts USING (group_id, token_idx) WINDOW w AS (PARTITION BY group_id))
SELECT group_id, token_idx,
  round(0.5 * et / sum(et) OVER w + 0.5 * cls_score, 9) AS selection_score,
  round(0.5 * et / sum(et) OVER w + 0.5 * ec / sum(ec) OVER w, 9) AS recovery_score
FROM j WINDOW w AS (PARTITION BY group_id)""")
def q_combined_guidance_score(spark, sf):
    t = tb.tokens(spark, sf)
    ts = SC.max_pool_similarity(t, tb.text_tokens(spark, sf))
    j = t.join(ts, [G, "token_idx"])
    a = SC.combined_guidance_score(j, G, "text_score", "cls_score", 0.5).withColumnRenamed("guidance_score", "sel")
    b = SC.combined_guidance_score(a, G, "text_score", "cls_score", 0.5, soften_cls=True)
    return b.select(G, "token_idx", r9(F.col("sel")).alias("selection_score"),
                    r9(F.col("guidance_score")).alias("recovery_score"))


# ------------------------------------------------------------------ W1 / O2 / O3 / O4 / O5 / P7
_RANK = _T + """
, rk AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY cls_score DESC, token_idx) - 1)::INTEGER AS rank FROM tokens)
"""


@register("important_topk", _RANK + "SELECT group_id, token_idx, rank FROM rk WHERE rank < 5")
def q_important_topk(spark, sf):
    return S.important_topk(tb.tokens(spark, sf), G, "cls_score", 5).select(G, "token_idx", "rank")


@register("set_difference", _RANK + "SELECT group_id, token_idx FROM rk WHERE rank >= 10")
def q_set_difference(spark, sf):
    t = tb.tokens(spark, sf)
    return S.set_difference(t, S.important_topk(t, G, "cls_score", 10), G).select(G, "token_idx")


@register("mask_complement", _RANK + "SELECT group_id, token_idx FROM rk WHERE rank >= 10")
def q_mask_complement(spark, sf):
    t = tb.tokens(spark, sf)
    sel = S.important_topk(t, G, "cls_score", 10)
    return t.join(sel.select(G, "token_idx"), [G, "token_idx"], "left_anti").select(G, "token_idx")


@register("sort_selected", _RANK + """
SELECT group_id, token_idx, (row_number() OVER (PARTITION BY group_id ORDER BY token_idx) - 1)::INTEGER AS position
FROM rk WHERE rank < 10""")
def q_sort_selected(spark, sf):
    sel = S.important_topk(tb.tokens(spark, sf), G, "cls_score", 10)
    return S.sort_selected(sel, G).select(G, "token_idx", "position")


@register("append_recovered", _RANK + """
, sel AS (SELECT group_id, token_idx, 'important' AS stage,
            (row_number() OVER (PARTITION BY group_id ORDER BY token_idx) - 1)::INTEGER AS position FROM rk WHERE rank < 10)
, rec AS (SELECT group_id, token_idx, 'recovered' AS stage, (10 + rank - 10)::INTEGER AS position FROM rk WHERE rank >= 10 AND rank < 15)
SELECT * FROM sel UNION ALL SELECT * FROM rec""")
def q_append_recovered(spark, sf):
    t = tb.tokens(spark, sf)
    sel = S.sort_selected(S.important_topk(t, G, "cls_score", 10).withColumn("stage", F.lit("important")), G)
    rest = S.set_difference(t, sel, G)
    rec = S.recover_by_cls(rest, G, 5).withColumn("stage", F.lit("recovered"))
    out = S.append_recovered(sel.select(G, "token_idx", "stage", "position"), rec.select(G, "token_idx", "stage", "rank"), G)
    return out.select(G, "token_idx", "stage", "position")


@register("union_stages", _RANK + """
, rest AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY vec[2] DESC, token_idx) - 1)::INTEGER AS r2 FROM rk WHERE rank >= 6)
SELECT group_id, token_idx, 'important' AS stage FROM rk WHERE rank < 6
UNION ALL SELECT group_id, token_idx, 'diverse' FROM rest WHERE r2 < 4""")
def q_union_stages(spark, sf):
    t = tb.tokens(spark, sf)
    imp = S.important_topk(t, G, "cls_score", 6)
    rest = S.set_difference(t, imp, G).withColumn("v1", F.col("vec")[1])
    other = S.important_topk(rest, G, "v1", 4)
    return S.union_stages(imp.select(G, "token_idx", F.lit("important").alias("stage")),
                          other.select(G, "token_idx", F.lit("diverse").alias("stage")))


# ------------------------------------------------------------------ W13 / W14 / W15 / W16
@register("recover_topk", _RANK + """
, pr AS (SELECT * FROM rk WHERE rank >= 10)
, d AS (SELECT p.group_id, t.t_idx, p.token_idx, list_dot_product(p.vec, t.vec) AS a
        FROM pr p JOIN text_tokens t ON p.group_id = t.group_id)
, e AS (SELECT *, exp(a - max(a) OVER (PARTITION BY group_id, t_idx)) AS e FROM d)
, s AS (SELECT group_id, token_idx, avg(e / s) AS sc FROM (SELECT *, sum(e) OVER (PARTITION BY group_id, t_idx) AS s FROM e) GROUP BY ALL)
, r AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY sc DESC, token_idx) - 1)::INTEGER AS rank FROM s)
SELECT group_id, token_idx, rank, round(sc, 9) AS recovery_score FROM r WHERE rank < 5""")
def q_recover_topk(spark, sf):
    t = tb.tokens(spark, sf)
    pr = S.set_difference(t, S.important_topk(t, G, "cls_score", 10), G)
    r = S.recover_topk(pr, tb.text_tokens(spark, sf), G, 5)
    return r.select(G, "token_idx", "rank", r9(F.col("recovery_score")).alias("recovery_score"))


@register("recover_by_attention_sum", _ATTN + """
, rk AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY cls_score DESC, token_idx) - 1) AS rank FROM tokens)
, s AS (SELECT a.group_id, a.token_idx, sum(a.a) AS sc FROM attn a JOIN rk USING (group_id, token_idx) WHERE rk.rank >= 10 GROUP BY ALL)
, r AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY sc DESC, token_idx) - 1)::INTEGER AS rank FROM s)
SELECT group_id, token_idx, rank, round(sc, 9) AS recovery_score FROM r WHERE rank < 5""")
def q_recover_by_attention_sum(spark, sf):
    t = tb.tokens(spark, sf)
    pr = S.set_difference(t, S.important_topk(t, G, "cls_score", 10), G).select(G, "token_idx")
    r = S.recover_by_attention_sum(pr, attention_sums(t, tb.text_tokens(spark, sf), [G]), G, 5)
    return r.select(G, "token_idx", "rank", r9(F.col("recovery_score")).alias("recovery_score"))


@register("recover_by_cls", _RANK + """
, r AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY cls_score DESC, token_idx) - 1)::INTEGER AS r2 FROM rk WHERE rank >= 10)
SELECT group_id, token_idx, r2 AS rank FROM r WHERE r2 < 5""")
def q_recover_by_cls(spark, sf):
    t = tb.tokens(spark, sf)
    pr = S.set_difference(t, S.important_topk(t, G, "cls_score", 10), G)
    return S.recover_by_cls(pr, G, 5).select(G, "token_idx", "rank")


@register("topk_text_by_norm", _RANK + """
, tt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sqrt(list_dot_product(vec, vec)) DESC, t_idx) AS r
         FROM text_tokens) WHERE r <= 2)
, pr AS (SELECT * FROM rk WHERE rank >= 10)
, d AS (SELECT p.group_id, t.t_idx, p.token_idx, list_dot_product(p.vec, t.vec) AS a FROM pr p JOIN tt t ON p.group_id = t.group_id)
, e AS (SELECT *, exp(a - max(a) OVER (PARTITION BY group_id, t_idx)) AS e FROM d)
, s AS (SELECT group_id, token_idx, avg(e / s) AS sc FROM (SELECT *, sum(e) OVER (PARTITION BY group_id, t_idx) AS s FROM e) GROUP BY ALL)
, r AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY sc DESC, token_idx) - 1)::INTEGER AS rank FROM s)
SELECT group_id, token_idx, rank FROM r WHERE rank < 5""")
def q_topk_text_by_norm(spark, sf):
    t = tb.tokens(spark, sf)
    pr = S.set_difference(t, S.important_topk(t, G, "cls_score", 10), G)
    tt = S.topk_text_by_norm(tb.text_tokens(spark, sf), 2)
    return S.recover_topk(pr, tt, G, 5).select(G, "token_idx", "rank")


# ------------------------------------------------------------------ O1
@register("limit_100", duckdb_with("mc_items") + "SELECT idx, question FROM mc_items ORDER BY idx LIMIT 100")
def q_limit_100(spark, sf):
    return tb.mc_items(spark, sf).select("idx", "question").orderBy("idx").limit(100)


# ------------------------------------------------------------------ V6 / V7 / V8
_U = V.uniform_sql_duckdb(42, "group_id", "token_idx")


@register("weighted_sample", _T + f"""
, k AS (SELECT *, CASE WHEN cls_score > 0 THEN -ln({_U}) / cls_score ELSE 'inf'::DOUBLE END AS key FROM tokens)
, r AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY key, token_idx) - 1)::INTEGER AS sample_rank FROM k)
SELECT group_id, token_idx, sample_rank FROM r WHERE sample_rank < 8""")
def q_weighted_sample(spark, sf):
    s = S.weighted_sample(tb.tokens(spark, sf), G, "cls_score", 8, 42)
    return s.select(G, "token_idx", "sample_rank")


@register("uniform_sample", _T + f"""
, r AS (SELECT *, (row_number() OVER (PARTITION BY group_id ORDER BY {_U}, token_idx) - 1)::INTEGER AS sample_rank FROM tokens)
SELECT group_id, token_idx, sample_rank FROM r WHERE sample_rank < 8""")
def q_uniform_sample(spark, sf):
    return S.uniform_sample(tb.tokens(spark, sf), G, 8, 42).select(G, "token_idx", "sample_rank")


@register("presample_rule", _T + duckdb_with("configs").replace("WITH ", ", ") + """
, n AS (SELECT group_id, count(*)::INTEGER AS n FROM tokens GROUP BY 1)
, b AS (SELECT config_id, group_id, n, least(CAST(trunc(keep_ratio * n) AS INTEGER), n) AS keep FROM configs, n)
, c AS (SELECT *, CAST(trunc(keep * 0.6) AS INTEGER) AS imp FROM b)
SELECT config_id, group_id, n - imp AS remaining, keep - imp AS diverse,
  CASE WHEN keep >= n THEN 'keep_all' WHEN n - imp <= keep - imp THEN 'take_remaining'
       WHEN n - imp > 500 THEN 'presample' ELSE 'full' END AS branch,
  CASE WHEN keep >= n THEN 0 WHEN n - imp <= keep - imp THEN n - imp
       WHEN n - imp > 500 THEN least((keep - imp) * 4, n - imp) ELSE n - imp END AS candidates
FROM c""")
def q_presample_rule(spark, sf):
    t = tb.tokens(spark, sf)
    n = t.groupBy(G).agg(F.count(F.lit(1)).cast("int").alias("n"))
    from ..operators.evaluate import config_sweep
    c = P._budget(config_sweep(n, tb.configs(spark)))
    rem = F.col("n") - F.col("imp")
    branch = (F.when(F.col("keep") >= F.col("n"), "keep_all").when(rem <= F.col("div"), "take_remaining")
              .when(rem > 500, "presample").otherwise("full"))
    cands = (F.when(F.col("keep") >= F.col("n"), 0).when(rem <= F.col("div"), rem)
             .when(rem > 500, F.least(F.col("div") * 4, rem)).otherwise(rem))
    return c.select("config_id", G, rem.alias("remaining"), F.col("div").alias("diverse"),
                    branch.alias("branch"), cands.cast("int").alias("candidates"))


# ------------------------------------------------------------------ V15
def projection_matrix(d_in: int, d_out: int, seed: int = 7) -> list[list[float]]:
    """Seeded +-1/sqrt(d_out) entries from md5(seed:i:j) (same rule as ``V.uniform``)."""
    out = []
    for j in range(d_out):
        col = []
        for i in range(d_in):
            h = int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:13], 16)
            u = (h + 1.0) / V.UNIFORM_DENOM
            col.append((-1.0 if u < 0.5 else 1.0) / d_out ** 0.5)
        out.append(col)
    return out


_PM = projection_matrix(64, 16)


@register("project_vectors", _T + "SELECT group_id, token_idx, [" + ", ".join(
    "round(list_dot_product(vec, [" + ", ".join(repr(x) for x in col) + "]::DOUBLE[]), 6)" for col in _PM)
    + "] AS proj FROM tokens")
def q_project_vectors(spark, sf):
    t = tb.tokens(spark, sf)
    return t.select(G, "token_idx", F.array(*[
        F.round(V.dot("vec", F.array(*[F.lit(x) for x in col])), 6) for col in _PM]).alias("proj"))


# ------------------------------------------------------------------ V16 / V17
_WS = "[ \\t\\n\\r\\f]+"


@register("text_segments", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS toks FROM documents),
s AS (SELECT doc_id, toks, unnest(range(CAST((len(toks) - 1) // 64 + 1 AS BIGINT))) AS seg FROM w WHERE len(toks) > 0)
SELECT doc_id, seg::INTEGER AS seg_idx, len(toks[seg * 64 + 1: seg * 64 + 64])::INTEGER AS n_real,
  array_to_string(toks[seg * 64 + 1: seg * 64 + 64], ' ') AS seg_text FROM s""")
def q_text_segments(spark, sf):
    from ..functions.segments import text_segments
    d = tb.raw(spark, sf, "documents")
    return text_segments(d, "doc_id", "text", 64).select("doc_id", "seg_idx", "n_real", "seg_text")


@register("truncate_sequence", duckdb_with("questions") + f"""
, w AS (SELECT question_id, image_id, list_filter(regexp_split_to_array(question, '{_WS}'), lambda x: x <> '') AS toks FROM questions)
SELECT question_id, least(len(toks), 32)::INTEGER AS n_kept,
  max(least(len(toks), 32)) OVER (PARTITION BY image_id)::INTEGER AS padded_len FROM w""")
def q_truncate_sequence(spark, sf):
    from ..functions.segments import truncate_sequence
    q = tb.questions(spark, sf)
    return truncate_sequence(q, "image_id", "question", 32).select("question_id", "n_kept", "padded_len")


# ------------------------------------------------------------------ V14
@register("multi_query_fusion", _T + """
, qk AS (SELECT q.group_id, q.t_idx AS i, k.t_idx AS j, k.vec, list_dot_product(q.vec, k.vec) / sqrt(len(q.vec)::DOUBLE) AS s
         FROM text_tokens q JOIN text_tokens k USING (group_id))
, qe AS (SELECT *, exp(s - max(s) OVER (PARTITION BY group_id, i)) AS e FROM qk)
, qa AS (SELECT *, e / sum(e) OVER (PARTITION BY group_id, i) AS a FROM qe)
, qo AS (SELECT group_id, i, p, sum(a * vec[p]) AS o FROM qa, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL)
, f AS (SELECT group_id, p, avg(o) AS x FROM qo GROUP BY ALL)
SELECT group_id, list(round(v, 6) ORDER BY p) AS fused FROM (SELECT group_id, p, sum(x) AS v FROM f GROUP BY ALL) GROUP BY 1""")
def q_multi_query_fusion(spark, sf):
    f = P.fuse_queries(tb.text_tokens(spark, sf))
    return f.select(G, arr6(F.col("fused")).alias("fused"))


# ------------------------------------------------------------------ greedy kernels (rows-only)
@register("diverse_maxmin")
def q_diverse_maxmin(spark, sf):
    return K.diverse_maxmin(tb.tokens(spark, sf), [G], 12)


@register("diverse_maxmin_seeded")
def q_diverse_maxmin_seeded(spark, sf):
    return K.diverse_maxmin_seeded(tb.tokens(spark, sf), [G], 12, seed=42)


@register("diverse_text_guided")
def q_diverse_text_guided(spark, sf):
    t = tb.tokens(spark, sf).withColumn("weight", F.col("cls_score"))
    return K.diverse_text_guided(t, [G], 12)


@register("dedup_even_odd")
def q_dedup_even_odd(spark, sf):
    return K.dedup_tokens(tb.tokens(spark, sf), [G], 12)


@register("cluster_representatives")
def q_cluster_representatives(spark, sf):
    return C.cluster_select(tb.tokens(spark, sf), [G], 6, seed=42)


@register("kmeans_lloyd")
def q_kmeans_lloyd(spark, sf):
    return C.kmeans_assign(tb.tokens(spark, sf), [G], 4, seed=42)


@register("dpp_map")
def q_dpp_map(spark, sf):
    t = tb.tokens(spark, sf)
    rel = SC.query_relevance(t, tb.text_tokens(spark, sf))
    return K.dpp_select(t.join(rel, [G, "token_idx"]), [G], 12)


@register("centroid_recovery")
def q_centroid_recovery(spark, sf):
    from ..plans.recovery import centroid_recovery
    t = tb.tokens(spark, sf)
    pr = S.set_difference(t, S.important_topk(t, G, "cls_score", 10), G)
    r = centroid_recovery(pr, tb.text_tokens(spark, sf), k_clusters=8, k=5)
    return r.select(G, "token_idx", "rank", r9(F.col("recovery_score")).alias("recovery_score"))


@register("centroid_mapback")
def q_centroid_mapback(spark, sf):
    from ..plans.recovery import centroid_scores
    t = tb.tokens(spark, sf)
    c = centroid_scores(t, tb.text_tokens(spark, sf), k_clusters=8)
    return c.select(G, "token_idx", "cluster", r9(F.col("centroid_score")).alias("centroid_score"))


@register("recover_diverse")
def q_recover_diverse(spark, sf):
    from ..plans.recovery import recover_diverse
    t = tb.tokens(spark, sf)
    pr = S.set_difference(t, S.important_topk(t, G, "cls_score", 10), G)
    return recover_diverse(pr, tb.text_tokens(spark, sf), 5)


# ------------------------------------------------------------------ pruning plans
@register("prune_attention_diverse")
def q_prune_attention_diverse(spark, sf):
    return P.prune_attention_diverse(tb.tokens(spark, sf), tb.text_tokens(spark, sf), tb.configs(spark),
                                     presample_threshold=500)


@register("prune_attention_textweighted")
def q_prune_attention_textweighted(spark, sf):
    return P.prune_attention_textweighted(tb.tokens(spark, sf), tb.text_tokens(spark, sf),
                                          tb.configs(spark, text_weights=(0.0, 0.5)), presample_threshold=500)


@register("prune_multi_query")
def q_prune_multi_query(spark, sf):
    return P.prune_multi_query(tb.tokens(spark, sf), tb.text_tokens(spark, sf),
                               tb.configs(spark, keep_ratios=(0.05,), recovery_ratios=(0.1,),
                                          text_weights=(0.5, 1.0, 0.0)))


@register("prune_dpp")
def q_prune_dpp(spark, sf):
    return P.prune_dpp(tb.tokens(spark, sf), tb.text_tokens(spark, sf),
                       tb.configs(spark, keep_ratios=(0.25,), recovery_ratios=(0.0,)))


@register("prune_entropy")
def q_prune_entropy(spark, sf):
    sel = P.prune_entropy(tb.tokens(spark, sf), tb.text_tokens(spark, sf), tb.configs(spark))
    return sel.withColumn("summary_vec", arr6(F.col("summary_vec")))


@register("prune_text_guided")
def q_prune_text_guided(spark, sf):
    from ..plans.recovery import prune_text_guided
    return prune_text_guided(tb.tokens(spark, sf), tb.text_tokens(spark, sf), tb.configs(spark))


@register("no_prune", _T + duckdb_with("configs").replace("WITH ", ", ") + """
SELECT config_id, group_id, token_idx, 'all' AS stage,
  (row_number() OVER (PARTITION BY config_id, group_id ORDER BY token_idx) - 1)::INTEGER AS rank,
  (row_number() OVER (PARTITION BY config_id, group_id ORDER BY token_idx) - 1)::INTEGER AS position
FROM tokens, configs""")
def q_no_prune(spark, sf):
    return P.no_prune(tb.tokens(spark, sf), tb.configs(spark))


# ------------------------------------------------------------------ recursive-CTE oracles for greedy kernels
# One row per token carries the mutable state; each step picks per group with
# a window (lowest token on ties, as the kernels do) and updates every row.
_REC_K = 12

def _rec_maxmin_sql(k: int, start_key: str = "0", source: str | None = None, order: str = "token_idx") -> str:
    """Max-min greedy; the first pick minimises ``start_key`` (ties: ``order``)."""
    src = source or f"SELECT group_id, token_idx, {NORM} AS v, {start_key} AS u, token_idx AS o FROM tokens"
    return (_T.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, nv AS ({src})
, st(step, group_id, token_idx, v, u, o, run, rk) AS (
    SELECT 0, group_id, token_idx, v, u, o, CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER) FROM nv
    UNION ALL
    SELECT step + 1, group_id, token_idx, v, u, o,
           CASE WHEN run IS NULL THEN list_dot_product(v, pv) ELSE greatest(run, list_dot_product(v, pv)) END,
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok FROM st
          WINDOW w AS (PARTITION BY group_id ORDER BY rk IS NOT NULL, coalesce(run, -1e308),
                       CASE WHEN run IS NULL THEN u END, o
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < {k})
SELECT group_id, token_idx, rk AS pick_rank FROM st WHERE step = {k} AND rk IS NOT NULL""")


def _rec_text_guided_sql(k: int) -> str:
    return (_T.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, nv AS (SELECT group_id, token_idx, {NORM} AS v, cls_score AS w FROM tokens)
, st(step, group_id, token_idx, v, s, rk) AS (
    SELECT 0, group_id, token_idx, v, w, CAST(NULL AS INTEGER) FROM nv
    UNION ALL
    SELECT step + 1, group_id, token_idx, v,
           s - 0.8 * list_dot_product(v, pv),
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok FROM st
          WINDOW w AS (PARTITION BY group_id ORDER BY rk IS NOT NULL, s DESC, token_idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < {k})
SELECT group_id, token_idx, rk AS pick_rank FROM st WHERE step = {k} AND rk IS NOT NULL""")


def _rec_dpp_sql(k: int) -> str:
    kn = NORM.replace("vec", "k.vec")
    tn = NORM.replace("vec", "t.vec")
    return (_T.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, r0 AS (SELECT k.group_id, k.token_idx, -avg(list_dot_product({kn}, {tn})) AS r
         FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id GROUP BY ALL)
, rel AS (SELECT group_id, token_idx, (r - min(r) OVER (PARTITION BY group_id) + 1e-6) /
            (max(r) OVER (PARTITION BY group_id) - min(r) OVER (PARTITION BY group_id)) AS rel FROM r0)
, nv AS (SELECT t.group_id, t.token_idx, {NORM.replace("vec", "t.vec")} AS v, rel.rel
         FROM tokens t JOIN rel USING (group_id, token_idx))
, st(step, group_id, token_idx, v, rel, d2, c, rk) AS (
    SELECT 0, group_id, token_idx, v, rel, rel * rel * list_dot_product(v, v), CAST([] AS DOUBLE[]), CAST(NULL AS INTEGER) FROM nv
    UNION ALL
    SELECT step + 1, group_id, token_idx, v, rel,
           d2 - e * e, list_append(c, e),
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, (prel * list_dot_product(v, pv) * rel
                     - CASE WHEN len(c) = 0 THEN 0.0 ELSE list_dot_product(pc, c) END) / sqrt(greatest(pd2, 1e-12)) AS e
          FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok,
                       first_value(rel) OVER w AS prel, first_value(c) OVER w AS pc, first_value(d2) OVER w AS pd2 FROM st
                WINDOW w AS (PARTITION BY group_id ORDER BY rk IS NOT NULL, d2 DESC, token_idx
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
    WHERE step < {k})
SELECT group_id, token_idx, rk AS pick_rank FROM st WHERE step = {k} AND rk IS NOT NULL""")


SQL["diverse_maxmin"] = _rec_maxmin_sql(_REC_K)
SQL["diverse_maxmin_seeded"] = _rec_maxmin_sql(_REC_K, V.uniform_sql_duckdb(42, "group_id", "token_idx"))


def _rec_recover_diverse_sql(k: int) -> str:
    """Top ``2k`` pruned tokens by the W13 score, then ``k`` max-min
    picks among them in score order (start = best score)."""
    w13 = SQL["recover_topk"]
    chain = w13[:w13.rindex("\nSELECT group_id, token_idx, rank, round")]
    body = _rec_maxmin_sql(k, source=f"""SELECT r.group_id, r.token_idx, {NORM.replace("vec", "t.vec")} AS v, 0 AS u,
        r.rank AS o FROM r JOIN tokens t USING (group_id, token_idx) WHERE r.rank < {2 * k}""")
    recursive = body[body.index("\n, nv AS"):].replace("rk AS pick_rank FROM st", "rk AS rank FROM st")
    return chain.replace("WITH ", "WITH RECURSIVE ", 1) + recursive


SQL["recover_diverse"] = _rec_recover_diverse_sql(5)
SQL["diverse_text_guided"] = _rec_text_guided_sql(_REC_K)
SQL["dpp_map"] = _rec_dpp_sql(_REC_K)


# ------------------------------------------------------------------ C1 oracle (threshold 500, 12-config grid)
def _rec_c1_sql(threshold: int = 500, seed: int = 42) -> str:
    u = V.uniform_sql_duckdb(seed, "group_id", "level_id", "token_idx")
    head = duckdb_with("tokens", "text_tokens", "configs").replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f"""
, gn AS (SELECT group_id, count(*)::INTEGER AS n FROM tokens GROUP BY 1)
, lvl AS (SELECT keep_ratio, important_ratio, (dense_rank() OVER (ORDER BY keep_ratio, important_ratio) - 1)::INTEGER AS level_id
          FROM (SELECT DISTINCT keep_ratio, important_ratio FROM configs))
, t AS (SELECT k.group_id, k.token_idx, k.vec, k.cls_score, gn.n,
          (row_number() OVER (PARTITION BY k.group_id ORDER BY k.cls_score DESC, k.token_idx) - 1)::INTEGER AS score_rank
        FROM tokens k JOIN gn USING (group_id))
, tl AS (SELECT t.*, l.level_id, l.important_ratio, least(CAST(trunc(l.keep_ratio * t.n) AS INTEGER), t.n) AS keep FROM t, lvl l)
, tb AS (SELECT *, CAST(trunc(keep * important_ratio) AS INTEGER) AS imp FROM tl)
, part AS (SELECT *, keep - imp AS div, n - imp AS rn FROM tb WHERE keep < n)
, imp AS (SELECT group_id, level_id, token_idx, 'important' AS stage, score_rank AS rank FROM part WHERE score_rank < imp)
, rem AS (SELECT * FROM part WHERE score_rank >= imp AND rn > div)
, samp AS (SELECT *, CASE WHEN rn > {threshold} THEN
             (row_number() OVER (PARTITION BY group_id, level_id ORDER BY {u}, token_idx) - 1) ELSE token_idx END AS o,
             CASE WHEN rn > {threshold} THEN least(div * 4, rn) END AS m FROM rem)
, nv AS (SELECT group_id, level_id, token_idx, {NORM} AS v, div AS kk, o FROM samp WHERE m IS NULL OR o < m)
, st(step, group_id, level_id, token_idx, v, kk, o, run, rk) AS (
    SELECT 0, group_id, level_id, token_idx, v, kk, o, CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER) FROM nv
    UNION ALL
    SELECT step + 1, group_id, level_id, token_idx, v, kk, o,
           CASE WHEN run IS NULL THEN list_dot_product(v, pv) ELSE greatest(run, list_dot_product(v, pv)) END,
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok FROM st
          WINDOW w AS (PARTITION BY group_id, level_id ORDER BY rk IS NOT NULL, coalesce(run, -1e308), o
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < kk)
, div AS (SELECT group_id, level_id, token_idx, 'diverse' AS stage, rk AS rank FROM st WHERE step = kk AND rk IS NOT NULL)
, sel AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY token_idx) - 1)::INTEGER AS position
          FROM (SELECT * FROM imp UNION ALL SELECT * FROM div))
, pruned AS (SELECT p.* FROM part p ANTI JOIN sel s USING (group_id, level_id, token_idx))
, d AS (SELECT p.group_id, p.level_id, p.token_idx, t.t_idx, list_dot_product(p.vec, t.vec) AS a
        FROM pruned p JOIN text_tokens t ON p.group_id = t.group_id)
, e AS (SELECT *, exp(a - max(a) OVER (PARTITION BY group_id, level_id, t_idx)) AS e FROM d)
, sc AS (SELECT group_id, level_id, token_idx, avg(e / s) AS sc
         FROM (SELECT *, sum(e) OVER (PARTITION BY group_id, level_id, t_idx) AS s FROM e) GROUP BY ALL)
, rr AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY sc DESC, token_idx) - 1)::INTEGER AS rank FROM sc)
, cfg AS (SELECT c.config_id, c.recovery_ratio, l.level_id FROM configs c JOIN lvl l USING (keep_ratio, important_ratio))
, kn AS (SELECT DISTINCT group_id, level_id, n, keep FROM part)
SELECT c.config_id, s.group_id, s.token_idx, s.stage, s.rank, s.position FROM sel s JOIN cfg c USING (level_id)
UNION ALL
SELECT c.config_id, r.group_id, r.token_idx, 'recovered', r.rank, (kn.keep + r.rank)::INTEGER
FROM rr r JOIN kn USING (group_id, level_id) JOIN cfg c USING (level_id)
WHERE r.rank < greatest(least(CAST(trunc(c.recovery_ratio * kn.n) AS INTEGER), kn.n - kn.keep), 0)"""


SQL["prune_attention_diverse"] = _rec_c1_sql()


# ------------------------------------------------------------------ C5 oracle (keep 0.25, no recovery)
def _rec_c5_sql() -> str:
    kn = NORM.replace("vec", "k.vec")
    tn = NORM.replace("vec", "t.vec")
    head = duckdb_with("tokens", "text_tokens").replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f"""
, r0 AS (SELECT k.group_id, k.token_idx, -avg(list_dot_product({kn}, {tn})) AS r
         FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id GROUP BY ALL)
, rel AS (SELECT group_id, token_idx, (r - min(r) OVER (PARTITION BY group_id) + 1e-6) /
            (max(r) OVER (PARTITION BY group_id) - min(r) OVER (PARTITION BY group_id)) AS rel FROM r0)
, gn AS (SELECT group_id, count(*)::INTEGER AS n FROM tokens GROUP BY 1)
, nv AS (SELECT t.group_id, t.token_idx, {NORM.replace("vec", "t.vec")} AS v, rel.rel,
           least(CAST(trunc(0.25 * gn.n) AS INTEGER), gn.n) AS kk, gn.n
         FROM tokens t JOIN rel USING (group_id, token_idx) JOIN gn USING (group_id))
, st(step, group_id, token_idx, v, rel, kk, d2, c, rk) AS (
    SELECT 0, group_id, token_idx, v, rel, kk, rel * rel * list_dot_product(v, v), CAST([] AS DOUBLE[]), CAST(NULL AS INTEGER)
    FROM nv WHERE kk < n
    UNION ALL
    SELECT step + 1, group_id, token_idx, v, rel, kk, d2 - e * e, list_append(c, e),
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, (prel * list_dot_product(v, pv) * rel
                     - CASE WHEN len(c) = 0 THEN 0.0 ELSE list_dot_product(pc, c) END) / sqrt(greatest(pd2, 1e-12)) AS e
          FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok,
                       first_value(rel) OVER w AS prel, first_value(c) OVER w AS pc, first_value(d2) OVER w AS pd2 FROM st
                WINDOW w AS (PARTITION BY group_id ORDER BY rk IS NOT NULL, d2 DESC, token_idx
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
    WHERE step < kk)
SELECT 0 AS config_id, group_id, token_idx, 'dpp' AS stage, rk AS rank,
       (row_number() OVER (PARTITION BY group_id ORDER BY token_idx) - 1)::INTEGER AS position
FROM st WHERE step = kk AND rk IS NOT NULL"""


SQL["prune_dpp"] = _rec_c5_sql()


# ------------------------------------------------------------------ C6 oracle (12-config grid)
SQL["prune_entropy"] = duckdb_with("tokens", "text_tokens", "configs") + """
, d AS (SELECT k.group_id, t.t_idx, k.token_idx, list_dot_product(k.vec, t.vec) AS d
        FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id)
, e AS (SELECT *, exp(d - max(d) OVER (PARTITION BY group_id, t_idx)) AS e FROM d)
, attn AS (SELECT group_id, t_idx, token_idx, e / sum(e) OVER (PARTITION BY group_id, t_idx) AS a FROM e)
, pc AS (SELECT *, greatest(a / (sum(a) OVER (PARTITION BY group_id, token_idx) + 1e-10), 1e-10) AS p FROM attn)
, es AS (SELECT group_id, token_idx, -0.1 * -sum(p * ln(p)) AS es FROM pc GROUP BY ALL)
, gn AS (SELECT group_id, count(*)::INTEGER AS n FROM tokens GROUP BY 1)
, t AS (SELECT es.*, gn.n, (row_number() OVER (PARTITION BY es.group_id ORDER BY es.es DESC, es.token_idx) - 1)::INTEGER AS score_rank
        FROM es JOIN gn USING (group_id))
, kb AS (SELECT c.config_id, c.recovery_ratio, t.*, least(CAST(trunc(c.keep_ratio * t.n) AS INTEGER), t.n) AS keep FROM configs c, t)
, att AS (SELECT group_id, token_idx, sum(a) AS rs FROM attn GROUP BY ALL)
, pr AS (SELECT kb.*, att.rs FROM kb JOIN att USING (group_id, token_idx) WHERE score_rank >= keep)
, rr AS (SELECT *, (row_number() OVER (PARTITION BY config_id, group_id ORDER BY rs DESC, token_idx) - 1)::INTEGER AS rank FROM pr)
, px AS (SELECT pr.config_id, pr.group_id, pr.keep, unnest(k.vec) AS x, unnest(range(len(k.vec))) AS p
         FROM pr JOIN tokens k ON k.group_id = pr.group_id AND k.token_idx = pr.token_idx)
, pm AS (SELECT config_id, group_id, keep, p, avg(x) AS m FROM px GROUP BY ALL)
, sv AS (SELECT config_id, group_id, keep, list(round(m, 6) ORDER BY p) AS v FROM pm GROUP BY ALL)
SELECT config_id, group_id, token_idx, 'important' AS stage, score_rank AS rank, score_rank AS position,
       CAST(NULL AS DOUBLE[]) AS summary_vec FROM kb WHERE score_rank < keep
UNION ALL
SELECT config_id, group_id, CAST(NULL AS BIGINT), 'summary', 0, keep, v FROM sv
UNION ALL
SELECT config_id, group_id, token_idx, 'recovered', rank, (keep + 1 + rank)::INTEGER, NULL FROM rr
WHERE rank < greatest(least(CAST(trunc(recovery_ratio * n) AS INTEGER), n - keep), 0)"""


# ------------------------------------------------------------------ C4 oracle (keep .05, recovery .1, text weight .5 / 1 / 0)
def _c4_sql() -> str:
    u = V.uniform_sql_duckdb(42, "group_id", "level_id", "token_idx")
    fused = SQL["multi_query_fusion"]
    chain = fused[:fused.rindex("\nSELECT group_id, list(round(v, 6)")].replace("WITH ", "WITH ", 1)
    return chain + f"""
, fz AS (SELECT group_id, list(v ORDER BY p) AS fused FROM (SELECT group_id, p, sum(x) AS v FROM f GROUP BY ALL) GROUP BY 1)
, lv AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE, 0), (1, 1.0::DOUBLE, 1), (2, 0.0::DOUBLE, 2)) v(level_id, w, config_id))
, gn AS (SELECT group_id, count(*)::INTEGER AS n FROM tokens GROUP BY 1)
, t AS (SELECT k.*, gn.n, (row_number() OVER (PARTITION BY k.group_id ORDER BY k.cls_score DESC, k.token_idx) - 1)::INTEGER AS score_rank
        FROM tokens k JOIN gn USING (group_id))
, kb AS (SELECT t.*, lv.level_id, lv.w, lv.config_id, least(CAST(trunc(0.05 * t.n) AS INTEGER), t.n) AS keep FROM t, lv)
, kb2 AS (SELECT *, CAST(trunc(keep * 0.6) AS INTEGER) AS imp FROM kb WHERE keep < n)
, imp AS (SELECT config_id, group_id, level_id, token_idx, 'important' AS stage, score_rank AS rank FROM kb2 WHERE score_rank < imp)
, rem AS (SELECT kb2.*, CASE WHEN fz.fused IS NOT NULL THEN list_dot_product(fz.fused, kb2.vec) END AS ts
          FROM kb2 LEFT JOIN fz USING (group_id) WHERE score_rank >= imp)
, rem2 AS (SELECT *, exp(ts - max(ts) OVER (PARTITION BY group_id, level_id)) AS ets FROM rem)
, rem3 AS (SELECT *, CASE WHEN ts IS NOT NULL THEN w * ets / sum(ets) OVER (PARTITION BY group_id, level_id) + (1.0 - w) * cls_score
                     ELSE cls_score END AS fin FROM rem2)
, samp AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY
              CASE WHEN fin > 0 THEN -ln({u}) / fin ELSE 'inf'::DOUBLE END, token_idx) - 1)::INTEGER AS rank FROM rem3)
, div AS (SELECT config_id, group_id, level_id, token_idx, 'diverse' AS stage, rank FROM samp WHERE rank < keep - imp)
, sel AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY token_idx) - 1)::INTEGER AS position
          FROM (SELECT * FROM imp UNION ALL SELECT * FROM div))
, pruned AS (SELECT k.*, fz.fused FROM kb2 k LEFT JOIN fz USING (group_id) ANTI JOIN sel s USING (group_id, level_id, token_idx))
, pa AS (SELECT *, CASE WHEN fused IS NOT NULL THEN list_dot_product(fused, vec) END AS a FROM pruned)
, pb AS (SELECT *, exp(a - max(a) OVER (PARTITION BY group_id, level_id)) AS ea,
               exp(cls_score - max(cls_score) OVER (PARTITION BY group_id, level_id)) AS ec FROM pa)
, pc AS (SELECT *, CASE WHEN fused IS NOT NULL THEN w * ea / sum(ea) OVER (PARTITION BY group_id, level_id)
                      + (1.0 - w) * ec / sum(ec) OVER (PARTITION BY group_id, level_id) ELSE cls_score END AS sc FROM pb)
, rr AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY sc DESC, token_idx) - 1)::INTEGER AS rank FROM pc)
SELECT config_id, group_id, token_idx, stage, rank, position FROM sel
UNION ALL
SELECT config_id, group_id, token_idx, 'recovered', rank, (keep + rank)::INTEGER FROM rr
WHERE rank < greatest(least(CAST(trunc(0.1 * n) AS INTEGER), n - keep), 0)"""


SQL["prune_multi_query"] = _c4_sql()


# ------------------------------------------------------------------ C2 oracle (threshold 500, text weight 0 / 0.5)
def _c2_sql(threshold: int = 500, seed: int = 42) -> str:
    u = V.uniform_sql_duckdb(seed, "group_id", "level_id", "token_idx")
    head = duckdb_with("tokens", "text_tokens").replace("WITH ", "WITH RECURSIVE ", 1)
    grid = ", ".join(f"({i}, {k}::DOUBLE, {r}::DOUBLE, {w}::DOUBLE)" for i, (k, r, w) in enumerate(
        (k, r, w) for k in tb.KEEP_RATIOS for r in tb.RECOVERY_RATIOS for w in (0.0, 0.5)))
    return head + f"""
, configs AS (SELECT * FROM (VALUES {grid}) v(config_id, keep_ratio, recovery_ratio, w))
, lvl AS (SELECT keep_ratio, w, (dense_rank() OVER (ORDER BY keep_ratio, w) - 1)::INTEGER AS level_id
          FROM (SELECT DISTINCT keep_ratio, w FROM configs))
, gn AS (SELECT group_id, count(*)::INTEGER AS n FROM tokens GROUP BY 1)
, t AS (SELECT k.group_id, k.token_idx, k.vec, gn.n,
          (row_number() OVER (PARTITION BY k.group_id ORDER BY k.cls_score DESC, k.token_idx) - 1)::INTEGER AS score_rank
        FROM tokens k JOIN gn USING (group_id))
, tl AS (SELECT t.*, l.level_id, l.w, least(CAST(trunc(l.keep_ratio * t.n) AS INTEGER), t.n) AS keep FROM t, lvl l)
, tb AS (SELECT *, CAST(trunc(keep * 0.6) AS INTEGER) AS imp FROM tl)
, part AS (SELECT *, keep - imp AS div, n - imp AS rn FROM tb WHERE keep < n)
, imp AS (SELECT group_id, level_id, token_idx, 'important' AS stage, score_rank AS rank FROM part WHERE score_rank < imp)
, rem AS (SELECT * FROM part WHERE score_rank >= imp AND rn > div)
, samp AS (SELECT *, CASE WHEN rn > {threshold} THEN (row_number() OVER (PARTITION BY group_id, level_id ORDER BY
               CASE WHEN w > 0 THEN -ln({u}) ELSE {u} END, token_idx) - 1) ELSE token_idx END AS o,
             CASE WHEN rn > {threshold} THEN least(div * CASE WHEN w > 0 THEN 3 ELSE 4 END, rn) END AS m FROM rem)
, nv AS (SELECT group_id, level_id, token_idx, {NORM} AS v, div AS kk, o FROM samp
         WHERE (m IS NOT NULL AND o < m) OR (m IS NULL AND w <= 0))
, st(step, group_id, level_id, token_idx, v, kk, o, run, rk) AS (
    SELECT 0, group_id, level_id, token_idx, v, kk, o, CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER) FROM nv
    UNION ALL
    SELECT step + 1, group_id, level_id, token_idx, v, kk, o,
           CASE WHEN run IS NULL THEN list_dot_product(v, pv) ELSE greatest(run, list_dot_product(v, pv)) END,
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok FROM st
          WINDOW w AS (PARTITION BY group_id, level_id ORDER BY rk IS NOT NULL, coalesce(run, -1e308), o
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < kk)
, gv AS (SELECT group_id, level_id, token_idx, {NORM} AS v, div AS kk FROM samp WHERE m IS NULL AND w > 0)
, tg(step, group_id, level_id, token_idx, v, kk, s, rk) AS (
    SELECT 0, group_id, level_id, token_idx, v, kk, 1.0::DOUBLE, CAST(NULL AS INTEGER) FROM gv
    UNION ALL
    SELECT step + 1, group_id, level_id, token_idx, v, kk, s - 0.8 * list_dot_product(v, pv),
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok FROM tg
          WINDOW w AS (PARTITION BY group_id, level_id ORDER BY rk IS NOT NULL, s DESC, token_idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < kk)
, div AS (SELECT group_id, level_id, token_idx, 'diverse' AS stage, rk AS rank FROM st WHERE step = kk AND rk IS NOT NULL
          UNION ALL
          SELECT group_id, level_id, token_idx, 'diverse', rk FROM tg WHERE step = kk AND rk IS NOT NULL)
, sel AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY token_idx) - 1)::INTEGER AS position
          FROM (SELECT * FROM imp UNION ALL SELECT * FROM div))
, pruned AS (SELECT p.* FROM part p ANTI JOIN sel s USING (group_id, level_id, token_idx))
, d AS (SELECT p.group_id, p.level_id, p.token_idx, t.t_idx, list_dot_product(p.vec, t.vec) AS a
        FROM pruned p JOIN text_tokens t ON p.group_id = t.group_id)
, e AS (SELECT *, exp(a - max(a) OVER (PARTITION BY group_id, level_id, t_idx)) AS e FROM d)
, sc AS (SELECT group_id, level_id, token_idx, avg(e / s) AS sc
         FROM (SELECT *, sum(e) OVER (PARTITION BY group_id, level_id, t_idx) AS s FROM e) GROUP BY ALL)
, rr AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY sc DESC, token_idx) - 1)::INTEGER AS rank FROM sc)
, cfg AS (SELECT c.config_id, c.recovery_ratio, l.level_id FROM configs c JOIN lvl l USING (keep_ratio, w))
, kn AS (SELECT DISTINCT group_id, level_id, n, keep FROM part)
SELECT c.config_id, s.group_id, s.token_idx, s.stage, s.rank, s.position FROM sel s JOIN cfg c USING (level_id)
UNION ALL
SELECT c.config_id, r.group_id, r.token_idx, 'recovered', r.rank, (kn.keep + r.rank)::INTEGER
FROM rr r JOIN kn USING (group_id, level_id) JOIN cfg c USING (level_id)
WHERE r.rank < greatest(least(CAST(trunc(c.recovery_ratio * kn.n) AS INTEGER), kn.n - kn.keep), 0)"""


SQL["prune_attention_textweighted"] = _c2_sql()


# ------------------------------------------------------------------ C3 oracle (12-config grid, hybrid weight 0.5)
def _c3_sql() -> str:
    head = duckdb_with("tokens", "text_tokens", "configs").replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f"""
, ts AS (SELECT k.group_id, k.token_idx, max(list_dot_product(k.vec, t.vec)) AS text_score
         FROM tokens k JOIN text_tokens t ON k.group_id = t.group_id GROUP BY ALL)
, hj AS (SELECT k.group_id, k.token_idx, k.vec, k.cls_score, ts.text_score FROM tokens k JOIN ts USING (group_id, token_idx))
, hy AS (SELECT *, 0.5 * (cls_score - min(cls_score) OVER w) / (max(cls_score) OVER w - min(cls_score) OVER w + 1e-8)
           + 0.5 * (text_score - min(text_score) OVER w) / (max(text_score) OVER w - min(text_score) OVER w + 1e-8) AS h
         FROM hj WINDOW w AS (PARTITION BY group_id))
, gn AS (SELECT group_id, count(*)::INTEGER AS n FROM hy GROUP BY 1)
, lvl AS (SELECT keep_ratio, important_ratio, (dense_rank() OVER (ORDER BY keep_ratio, important_ratio) - 1)::INTEGER AS level_id
          FROM (SELECT DISTINCT keep_ratio, important_ratio FROM configs))
, t AS (SELECT hy.*, gn.n, (row_number() OVER (PARTITION BY hy.group_id ORDER BY hy.h DESC, hy.token_idx) - 1)::INTEGER AS score_rank
        FROM hy JOIN gn USING (group_id))
, tl AS (SELECT t.*, l.level_id, l.important_ratio, least(CAST(trunc(l.keep_ratio * t.n) AS INTEGER), t.n) AS keep FROM t, lvl l)
, tb AS (SELECT *, CAST(trunc(keep * important_ratio) AS INTEGER) AS imp FROM tl)
, part AS (SELECT *, keep - imp AS div FROM tb WHERE keep < n)
, imp AS (SELECT group_id, level_id, token_idx, 'important' AS stage, score_rank AS rank FROM part WHERE score_rank < imp)
, gv AS (SELECT group_id, level_id, token_idx, {NORM} AS v, div AS kk, h FROM part WHERE score_rank >= imp)
, tg(step, group_id, level_id, token_idx, v, kk, s, rk) AS (
    SELECT 0, group_id, level_id, token_idx, v, kk, h, CAST(NULL AS INTEGER) FROM gv
    UNION ALL
    SELECT step + 1, group_id, level_id, token_idx, v, kk, s - 0.8 * list_dot_product(v, pv),
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok FROM tg
          WINDOW w AS (PARTITION BY group_id, level_id ORDER BY rk IS NOT NULL, s DESC, token_idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < kk)
, div AS (SELECT group_id, level_id, token_idx, 'diverse' AS stage, rk AS rank FROM tg WHERE step = kk AND rk IS NOT NULL)
, sel AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY token_idx) - 1)::INTEGER AS position
          FROM (SELECT * FROM imp UNION ALL SELECT * FROM div))
, pruned AS (SELECT p.* FROM part p ANTI JOIN sel s USING (group_id, level_id, token_idx))
, d AS (SELECT p.group_id, p.level_id, p.token_idx, t.t_idx, list_dot_product(p.vec, t.vec) AS a
        FROM pruned p JOIN text_tokens t ON p.group_id = t.group_id)
, e AS (SELECT *, exp(a - max(a) OVER (PARTITION BY group_id, level_id, t_idx)) AS e FROM d)
, sc AS (SELECT group_id, level_id, token_idx, avg(e / s) AS sc
         FROM (SELECT *, sum(e) OVER (PARTITION BY group_id, level_id, t_idx) AS s FROM e) GROUP BY ALL)
, rr AS (SELECT *, (row_number() OVER (PARTITION BY group_id, level_id ORDER BY sc DESC, token_idx) - 1)::INTEGER AS rank FROM sc)
, cfg AS (SELECT c.config_id, c.recovery_ratio, l.level_id FROM configs c JOIN lvl l USING (keep_ratio, important_ratio))
, kn AS (SELECT DISTINCT group_id, level_id, n, keep FROM part)
, cand AS (SELECT c.config_id, r.group_id, r.token_idx, {NORM.replace("vec", "p.vec")} AS v, r.rank AS o, kn.keep,
             greatest(least(CAST(trunc(c.recovery_ratio * kn.n) AS INTEGER), kn.n - kn.keep), 0) AS kk
           FROM rr r JOIN kn USING (group_id, level_id) JOIN cfg c USING (level_id) JOIN tokens p ON p.group_id = r.group_id AND p.token_idx = r.token_idx)
, dv(step, config_id, group_id, token_idx, v, kk, o, run, rk) AS (
    SELECT 0, config_id, group_id, token_idx, v, kk, o, CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER) FROM cand WHERE o < 2 * kk
    UNION ALL
    SELECT step + 1, config_id, group_id, token_idx, v, kk, o,
           CASE WHEN run IS NULL THEN list_dot_product(v, pv) ELSE greatest(run, list_dot_product(v, pv)) END,
           CASE WHEN rk IS NULL AND token_idx = ptok THEN step ELSE rk END
    FROM (SELECT *, first_value(v) OVER w AS pv, first_value(token_idx) OVER w AS ptok FROM dv
          WINDOW w AS (PARTITION BY config_id, group_id ORDER BY rk IS NOT NULL, coalesce(run, -1e308), o
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < kk)
, chosen AS (SELECT config_id, group_id, token_idx, CASE WHEN count(*) OVER (PARTITION BY config_id, group_id) <= kk THEN o ELSE rk END AS rank, kk
             FROM dv WHERE step = kk)
SELECT c.config_id, s.group_id, s.token_idx, s.stage, s.rank, s.position FROM sel s JOIN cfg c USING (level_id)
UNION ALL
SELECT d.config_id, d.group_id, d.token_idx, 'recovered', d.rank, (k.keep + d.rank)::INTEGER
FROM chosen d JOIN cand k USING (config_id, group_id, token_idx) WHERE d.rank IS NOT NULL"""


SQL["prune_text_guided"] = _c3_sql()


# ------------------------------------------------------------------ V5 oracle (target 12): one list of survivors per group
def _v5_sql(target: int = 12) -> str:
    head = _T.replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f"""
, g AS (SELECT group_id, list({NORM} ORDER BY token_idx) AS vs, list(token_idx ORDER BY token_idx) AS ids
        FROM tokens GROUP BY 1)
, st(group_id, vs, ids, rem) AS (
    SELECT group_id, vs, ids, range(len(ids)) FROM g
    UNION ALL
    SELECT group_id, vs, ids,
           list_concat(list_transform(list_slice(srt, r + 1, len(srt)), lambda x: x.e), od)
    FROM (SELECT *, list_sort(list_transform(ev, lambda e, i: {{'nb': -coalesce(list_max(
                 list_transform(od, lambda o: list_dot_product(vs[e + 1], vs[o + 1]))), 0.0), 'i': i, 'e': e}})) AS srt
          FROM (SELECT *, least(2, len(rem) - {target}) AS r,
                       list_slice(rem, 1, len(rem), 2) AS ev, list_slice(rem, 2, len(rem), 2) AS od FROM st))
    WHERE len(rem) > {target})
, fin AS (SELECT group_id, ids, rem FROM st WHERE len(rem) <= {target})
SELECT group_id, ids[rem[p] + 1] AS token_idx, (p - 1)::INTEGER AS pick_rank
FROM (SELECT *, unnest(range(1, len(rem) + 1)) AS p FROM fin)"""


SQL["dedup_even_odd"] = _v5_sql(12)


# ------------------------------------------------------------------ V9 / V10 / V11 / J8 oracles: ten Lloyd rounds, one CTE each
def _lloyd_sql(k: int, source: str = "tokens", seed: int = 42, rounds: int = 10) -> str:
    """CTEs kc0 .. kc<rounds> (group_id, cluster, c) and ka (group_id, token_idx, vec, cluster), the last assignment."""
    u = V.uniform_sql_duckdb(seed, "group_id", "token_idx")
    parts = [f"""kc0 AS (SELECT group_id, cluster, vec AS c FROM (SELECT group_id, vec,
        (row_number() OVER (PARTITION BY group_id ORDER BY {u}, token_idx) - 1)::INTEGER AS cluster FROM {source}) WHERE cluster < {k})"""]
    for r in range(rounds):
        parts.append(f"""kn{r} AS MATERIALIZED (SELECT t.group_id, t.token_idx, any_value(t.vec) AS vec,
        arg_min(c.cluster, (0.5 * list_dot_product(c.c, c.c) - list_dot_product(t.vec, c.c), c.cluster)) AS cluster
        FROM {source} t JOIN kc{r} c USING (group_id) GROUP BY 1, 2)
, km{r} AS (SELECT group_id, cluster, list(m ORDER BY p) AS c FROM (SELECT group_id, cluster, p, avg(vec[p]) AS m
        FROM kn{r}, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL) GROUP BY 1, 2)
, kj{r} AS (SELECT o.group_id, o.cluster, o.c AS old, coalesce(m.c, o.c) AS new FROM kc{r} o LEFT JOIN km{r} m USING (group_id, cluster))
, kd{r} AS (SELECT group_id, max(list_max(list_transform(list_zip(old, new), lambda z: (abs(z[1] - z[2]) > 1e-4 + 1e-5 * abs(z[2]))::INTEGER))) AS moved
        FROM kj{r} GROUP BY 1)
, kc{r + 1} AS MATERIALIZED (SELECT group_id, cluster, CASE WHEN moved = 1 THEN new ELSE old END AS c FROM kj{r} JOIN kd{r} USING (group_id))""")
    return ",\n".join(parts) + f",\nka AS (SELECT * FROM kn{rounds - 1})\n"


SQL["kmeans_lloyd"] = _T + ", " + _lloyd_sql(4) + "SELECT group_id, token_idx, cluster FROM ka"

_J8 = """, cent AS (SELECT group_id, cluster, list(m ORDER BY p) AS c FROM (SELECT group_id, cluster, p, avg(vec[p]) AS m
        FROM ka, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL) GROUP BY 1, 2)
, cd AS (SELECT c.group_id, c.cluster, t.t_idx, list_dot_product(t.vec, c.c) AS a FROM cent c JOIN text_tokens t USING (group_id))
, ce AS (SELECT *, exp(a - max(a) OVER (PARTITION BY group_id, t_idx)) AS e FROM cd)
, cs AS (SELECT group_id, cluster, avg(e / s) AS centroid_score
         FROM (SELECT *, sum(e) OVER (PARTITION BY group_id, t_idx) AS s FROM ce) GROUP BY ALL)
"""
SQL["centroid_mapback"] = _T + ", " + _lloyd_sql(8) + _J8 + """
SELECT group_id, token_idx, cluster, round(centroid_score, 9) AS centroid_score FROM ka JOIN cs USING (group_id, cluster)"""
SQL["centroid_recovery"] = _RANK + ", pr AS (SELECT group_id, token_idx, vec FROM rk WHERE rank >= 10), " + _lloyd_sql(8, "pr") + _J8 + """
, ranked AS (SELECT group_id, token_idx, centroid_score,
    (row_number() OVER (PARTITION BY group_id ORDER BY centroid_score DESC, token_idx) - 1)::INTEGER AS rank FROM ka JOIN cs USING (group_id, cluster))
SELECT group_id, token_idx, rank, round(centroid_score, 9) AS recovery_score FROM ranked WHERE rank < 5"""


def _v9_sql(k: int) -> str:
    """Farthest-first over the ``2k`` centres, from the one nearest the mean, then the nearest own token of each."""
    gap = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return _T.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _lloyd_sql(2 * k) + f"""
, mean AS (SELECT group_id, list(m ORDER BY p) AS m FROM (SELECT group_id, p, avg(vec[p]) AS m FROM tokens, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL) GROUP BY 1)
, ff(step, group_id, cluster, c, g, o) AS (
    SELECT 0, group_id, cluster, c, -{gap.format("c", "m")}, CAST(NULL AS INTEGER) FROM kc10 JOIN mean USING (group_id)
    UNION ALL
    SELECT step + 1, group_id, cluster, c, CASE WHEN step = 0 THEN {gap.format("c", "pc")} ELSE least(g, {gap.format("c", "pc")}) END,
           CASE WHEN o IS NULL AND cluster = pk THEN step ELSE o END
    FROM (SELECT *, first_value(c) OVER w AS pc, first_value(cluster) OVER w AS pk FROM ff
          WINDOW w AS (PARTITION BY group_id ORDER BY o IS NOT NULL, g DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE step < {k})
, near AS (SELECT a.group_id, a.cluster, arg_min(a.token_idx, ({gap.format("a.vec", "c.c")}, a.token_idx)) AS token_idx
           FROM ka a JOIN kc10 c USING (group_id, cluster) GROUP BY 1, 2)
SELECT group_id, token_idx, (row_number() OVER (PARTITION BY group_id ORDER BY o) - 1)::INTEGER AS pick_rank
FROM ff JOIN near USING (group_id, cluster) WHERE step = {k} AND o IS NOT NULL"""


SQL["cluster_representatives"] = _v9_sql(6)
