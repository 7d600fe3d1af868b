"""Registered queries: evaluation flows (C8-C10) and their grouping / join
steps (A1-A6, A8, A10, J2-J4, P5).  Pruned-token counts on the Spark side
come from the real pruning plans; the SQL twins derive them from the
budget formula, so these oracles also check the pruners' output sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..plans import evaluation as EV
from ..plans import pruners as P
from ..sources import tables as tb
from .sqlbits import duckdb_with, mc_parse, strip, yes_no
from .textq import VARIED_ANSWERS_SQL, gc_sql, varied_answers

QUERIES: dict = {}
SQL: dict = {}
G = "group_id"
N_GROUPS_MC = 10      # items map onto the 10 token groups
N_GROUPS_IMG = 13     # images map onto 13 groups; groups 10-12 have no tokens (failed pruning)


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _mc_responses(spark, sf):
    e = tb.eval_log(spark, sf)
    return e.where(F.col("api_success")).select(F.col("test_number").alias("item_id"),
                                               F.col("generated_text").alias("content"), "embed_time", "api_call_time")


# pruned-token count per (config, group) from the budget formula
_COUNTS = """
, gn AS (SELECT label::BIGINT AS group_id, count(*)::INTEGER AS n FROM embeddings GROUP BY 1)
, kb AS (SELECT c.*, gn.group_id, gn.n, least(CAST(trunc(c.keep_ratio * gn.n) AS INTEGER), gn.n) AS keep FROM configs c, gn)
, cnt AS (SELECT config_id, group_id, CASE WHEN keep >= n THEN n
            ELSE keep + greatest(least(CAST(trunc(recovery_ratio * n) AS INTEGER), n - keep), 0) END AS pruned_token FROM kb)
"""
_CONTENT = "coalesce(CASE WHEN json_valid(content) THEN json_extract_string(content, '$.choices[0].message.content') END, content)"

_A7 = """
SELECT keep_ratio, recovery_ratio, count(*) AS n,
       count(*) FILTER (WHERE api_success) AS n_success,
       count(*) FILTER (WHERE api_success AND is_correct) AS n_correct,
       round((count(*) FILTER (WHERE api_success AND is_correct)) / nullif(count(*) FILTER (WHERE api_success), 0), 6) AS accuracy,
       round(avg(embed_time) FILTER (WHERE api_success), 6) AS avg_embed_time,
       round(avg(api_call_time) FILTER (WHERE api_success), 6) AS avg_api_time,
       round(avg(pruned_token) FILTER (WHERE api_success), 6) AS avg_pruned_tokens,
       round((576.0 - avg(pruned_token) FILTER (WHERE api_success)) / 576.0 * 100.0, 6) AS token_reduction_pct
FROM res GROUP BY keep_ratio, recovery_ratio"""


# ------------------------------------------------------------------ C9
@register("mc_evaluation", duckdb_with("mc_items", "eval_log", "configs") + _COUNTS + f"""
, it AS (SELECT idx AS item_id, (idx % 10)::BIGINT AS group_id, coalesce(answer, '') AS correct_answer FROM mc_items)
, resp AS (SELECT test_number AS item_id, generated_text AS content, embed_time, api_call_time FROM eval_log WHERE api_success)
, j AS (SELECT c.config_id, c.keep_ratio, c.recovery_ratio, it.item_id, cnt.pruned_token, it.correct_answer,
          r.item_id IS NOT NULL AS api_success, r.content, r.embed_time, r.api_call_time
        FROM it JOIN configs c ON true JOIN cnt ON cnt.config_id = c.config_id AND cnt.group_id = it.group_id
        LEFT JOIN resp r ON r.item_id = it.item_id)
, res AS (SELECT *, coalesce(embed_time, 0.0) AS e2, coalesce(api_call_time, 0.0) AS a2,
            CASE WHEN api_success THEN {mc_parse(_CONTENT)} ELSE '' END AS predicted_answer FROM j)
, res2 AS (SELECT keep_ratio, recovery_ratio, pruned_token, api_success, e2 AS embed_time, a2 AS api_call_time,
             api_success AND coalesce(predicted_answer = upper(correct_answer), false) AS is_correct FROM res)
""" + _A7.replace("FROM res GROUP", "FROM res2 GROUP"))
def q_mc_evaluation(spark, sf):
    return EV.mc_evaluation(tb.mc_items(spark, sf), _mc_responses(spark, sf), tb.tokens(spark, sf),
                            tb.text_tokens(spark, sf), tb.configs(spark), N_GROUPS_MC)


# per-question results shared by C8 / C10 (SQL)
_QRES = duckdb_with("questions", "responses", "configs") + _COUNTS + f"""
, q AS (SELECT question_id, image_id, (image_id % 13)::BIGINT AS group_id,
          CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END AS answer
        FROM questions WHERE question IS NOT NULL AND length(question) > 0)
, j AS (SELECT c.config_id, c.keep_ratio, c.recovery_ratio, q.question_id, q.image_id, q.group_id, q.answer,
          cnt.pruned_token, r.question_id IS NOT NULL AS api_success, r.content
        FROM q JOIN configs c ON true JOIN cnt ON cnt.config_id = c.config_id AND cnt.group_id = q.group_id
        LEFT JOIN responses r ON r.question_id = q.question_id)
, qr AS (SELECT *, CASE WHEN api_success THEN {yes_no(_CONTENT)} ELSE '' END AS predicted_answer,
           pruned_token / 3000.0 AS prune_time,
           CASE WHEN api_success THEN length(content) / 1000.0 ELSE 0.0 END AS api_call_time FROM j)
, qr2 AS (SELECT *, api_success AND coalesce(predicted_answer = lower(trim(answer, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), false) AS is_correct FROM qr)
"""


# ------------------------------------------------------------------ C10
_A7_SUMS = """count(*) AS n, count(*) FILTER (WHERE api_success) AS n_success,
       count(*) FILTER (WHERE api_success AND is_correct) AS n_correct,
       round((count(*) FILTER (WHERE api_success AND is_correct)) / nullif(count(*) FILTER (WHERE api_success), 0), 6) AS accuracy,
       round(avg(embed_time) FILTER (WHERE api_success), 6) AS avg_embed_time,
       round(avg(api_call_time) FILTER (WHERE api_success), 6) AS avg_api_time,
       round(avg(pruned_token) FILTER (WHERE api_success), 6) AS avg_pruned_tokens,
       round((576.0 - avg(pruned_token) FILTER (WHERE api_success)) / 576.0 * 100.0, 6) AS token_reduction_pct"""


_QRES10 = duckdb_with("questions", "responses", "configs") + _COUNTS + f"""
, pl AS (SELECT page_id AS image_id, bool_or(page_id % 4 < 3 AND html IS NOT NULL) AS usable FROM pages GROUP BY 1)
, q AS (SELECT question_id, question, image_id, (image_id % 13)::BIGINT AS group_id, CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END AS answer,
          'image_' || (row_number() OVER (ORDER BY question_id) - 1) AS image_source FROM questions)
, j AS (SELECT c.config_id, c.keep_ratio, c.recovery_ratio, q.*, cnt.pruned_token, coalesce(usable, false) AS usable,
          coalesce(usable, false) AND r.question_id IS NOT NULL AS api_success, r.content
        FROM q JOIN configs c ON true JOIN cnt ON cnt.config_id = c.config_id AND cnt.group_id = q.group_id
        LEFT JOIN pl USING (image_id) LEFT JOIN responses r ON r.question_id = q.question_id)
, qr AS (SELECT *, CASE WHEN api_success THEN {yes_no(_CONTENT)} ELSE '' END AS predicted_answer,
           pruned_token / 3000.0 AS prune_time,
           CASE WHEN api_success THEN length(content) / 1000.0 ELSE 0.0 END AS api_call_time FROM j)
, qr2 AS (SELECT *, api_success AND coalesce(predicted_answer = answer, false) AS is_correct FROM qr)
"""


@register("yes_no_records", _QRES10 + """
SELECT config_id, keep_ratio, recovery_ratio, question_id, question, answer AS correct_answer, image_source, 'unknown' AS category,
       predicted_answer, is_correct, api_success, CASE WHEN api_success THEN content ELSE '' END AS generated_text,
       CASE WHEN NOT usable THEN 'error: unsupported payload' WHEN NOT api_success THEN 'No valid response from API' ELSE '' END AS error_message,
       576 AS original_tokens, CASE WHEN usable THEN pruned_token ELSE 0 END AS pruned_tokens FROM qr2""")
def q_yes_no_records(spark, sf):
    return EV.yes_no_records(tb.questions(spark, sf), tb.payload_variants(spark, sf), tb.responses(spark, sf), tb.tokens(spark, sf),
                             tb.text_tokens(spark, sf), tb.configs(spark), N_GROUPS_IMG)


@register("yes_no_evaluation", _QRES10 + f"""
, res AS (SELECT config_id, image_id, keep_ratio, recovery_ratio, pruned_token, api_success, is_correct, prune_time AS embed_time, api_call_time FROM qr2)
SELECT 'configuration' AS level, keep_ratio, recovery_ratio, NULL::VARCHAR AS config_key, NULL::BIGINT AS n_configs,
       NULL::DOUBLE AS success_rate, NULL::BIGINT AS unique_images, {_A7_SUMS} FROM res GROUP BY keep_ratio, recovery_ratio
UNION ALL
SELECT 'ratio_key', NULL, NULL, 'keep_' || keep_ratio || '_recovery_' || recovery_ratio, NULL, NULL, NULL, {_A7_SUMS}
FROM res WHERE api_success GROUP BY keep_ratio, recovery_ratio
UNION ALL
SELECT 'overall', NULL, NULL, NULL, count(DISTINCT config_id), round(count(*) FILTER (WHERE api_success) / count(*), 6),
       count(DISTINCT image_id), {_A7_SUMS} FROM res HAVING count(*) > 0""")
def q_yes_no_evaluation(spark, sf):
    return EV.yes_no_evaluation(tb.questions(spark, sf), tb.payload_variants(spark, sf), tb.responses(spark, sf), tb.tokens(spark, sf),
                                tb.text_tokens(spark, sf), tb.configs(spark), N_GROUPS_IMG)


# ------------------------------------------------------------------ C8 / A8
@register("prune_once_reuse", _QRES + """
, pi AS (SELECT config_id, image_id, count(*) AS q, min(prune_time) AS pt FROM qr2 GROUP BY ALL)
, res AS (SELECT qr2.*, prune_time / pi.q AS embed_time FROM qr2 JOIN pi USING (config_id, image_id))
, agg AS (SELECT config_id, keep_ratio, recovery_ratio, count(*) AS n, count(*) FILTER (WHERE api_success) AS n_success,
            count(*) FILTER (WHERE api_success AND is_correct) AS n_correct,
            sum(CASE WHEN api_success THEN api_call_time ELSE 0.0 END) AS tapi,
            avg(embed_time) FILTER (WHERE api_success) AS ae, avg(api_call_time) FILTER (WHERE api_success) AS aa,
            avg(pruned_token) FILTER (WHERE api_success) AS ap FROM res GROUP BY ALL)
, im AS (SELECT config_id, count(*) AS unique_images, sum(pt) AS tp FROM pi GROUP BY 1)
SELECT config_id, keep_ratio, recovery_ratio, unique_images, n, n_success, n_correct,
  round(n_correct / nullif(n_success, 0), 6) AS accuracy, round(tp, 6) AS total_pruning_time,
  round(tapi, 6) AS total_api_call_time, round(ae, 6) AS avg_embed_time, round(aa, 6) AS avg_api_time,
  round(ap, 6) AS avg_pruned_tokens, round((576.0 - ap) / 576.0 * 100.0, 6) AS token_reduction_pct
FROM agg JOIN im USING (config_id)""")
def q_prune_once_reuse(spark, sf):
    return EV.prune_once_reuse(tb.questions(spark, sf), tb.responses(spark, sf), tb.tokens(spark, sf),
                               tb.text_tokens(spark, sf), tb.configs(spark), N_GROUPS_IMG)


@register("config_summary_grouped", SQL["prune_once_reuse"])
def q_config_summary_grouped(spark, sf):
    return q_prune_once_reuse(spark, sf)


# ------------------------------------------------------------------ C8, guided choices
_HIT = f"list_filter(ch, lambda c: instr(lower({strip('txt')}), {strip('lower(c)')}) > 0)[1]"


@register("prune_once_reuse_guided", duckdb_with("mc_items", "configs") + _COUNTS + f"""
, g AS (SELECT idx AS item_id, (idx % 13)::BIGINT AS group_id, lower(B) AS correct_answer,
          question || ' ' || coalesce(hint, '') AS txt, {gc_sql(VARIED_ANSWERS_SQL)} AS ch FROM mc_items)
, s AS (SELECT item_id, group_id, correct_answer,
          CASE WHEN coalesce(len(ch), 0) > 0 THEN '[''' || array_to_string(ch, ''', ''') || ''']'
               ELSE '[''yes'', ''no'']' END AS guided_choices_used,
          CASE WHEN coalesce(len(ch), 0) > 0 THEN {strip(f"coalesce({strip('lower(' + _HIT + ')')}, lower({strip('txt')}))")}
               ELSE {strip(yes_no('txt'))} END AS predicted_answer FROM g)
, a AS (SELECT group_id, count(*) AS questions_used_for_pruning FROM s GROUP BY 1)
SELECT cnt.config_id, s.item_id, cnt.pruned_token, a.questions_used_for_pruning, s.guided_choices_used, s.predicted_answer,
       s.predicted_answer = {strip('s.correct_answer')} AS is_correct
FROM s JOIN cnt USING (group_id) JOIN a USING (group_id)""")
def q_prune_once_reuse_guided(spark, sf):
    m = tb.mc_items(spark, sf)
    items = m.select(F.col("idx").alias("item_id"), varied_answers(m).alias("answers"), F.lower("B").alias("correct_answer"))
    said = m.select(F.col("idx").alias("item_id"), F.concat("question", F.lit(" "), T.null_to_empty("hint")).alias("content"))
    return EV.guided_results(items, said, _counts(spark, sf), tb.configs(spark), N_GROUPS_IMG).select(
        "config_id", "item_id", "pruned_token", "questions_used_for_pruning", "guided_choices_used", "predicted_answer", "is_correct")


# ------------------------------------------------------------------ J2
def _counts(spark, sf):
    sel = P.prune_attention_textweighted(tb.tokens(spark, sf), tb.text_tokens(spark, sf), tb.configs(spark))
    return EV.pruned_counts(sel)


@register("cache_lookup", _QRES + "SELECT config_id, question_id, pruned_token FROM qr2")
def q_cache_lookup(spark, sf):
    q = E.non_empty_questions(tb.questions(spark, sf)).select(
        "question_id", (F.col("image_id") % N_GROUPS_IMG).cast("bigint").alias(G))
    swept = E.config_sweep(q, tb.configs(spark).select("config_id"))
    return E.cache_lookup(swept, _counts(spark, sf), ["config_id", G]).select("config_id", "question_id", "pruned_token")


# ------------------------------------------------------------------ A10
@register("config_totals", _QRES + """
, pi AS (SELECT config_id, image_id, min(prune_time) AS pt FROM qr2 GROUP BY ALL)
, t AS (SELECT config_id, sum(pt) AS tp FROM pi GROUP BY 1)
, a AS (SELECT config_id, sum(api_call_time) FILTER (WHERE api_success) AS ta FROM qr2 GROUP BY 1)
SELECT q.config_id, q.question_id, round(t.tp, 6) AS total_pruning_time_config,
       round(coalesce(a.ta, 0.0), 6) AS total_api_call_time_config
FROM qr2 q JOIN t USING (config_id) JOIN a USING (config_id)""")
def q_config_totals(spark, sf):
    res = EV.question_results(tb.questions(spark, sf), tb.responses(spark, sf), _counts(spark, sf),
                              tb.configs(spark), N_GROUPS_IMG)
    per_image = res.groupBy("config_id", "image_id").agg(F.min("prune_time").alias("pt"))
    t = per_image.groupBy("config_id").agg(F.sum("pt").alias("tp"))
    a = res.groupBy("config_id").agg(F.sum(F.when(F.col("api_success"), F.col("api_call_time"))).alias("ta"))
    out = res.join(t, "config_id").join(a, "config_id")
    return out.select("config_id", "question_id", F.round("tp", 6).alias("total_pruning_time_config"),
                      F.round(F.coalesce(F.col("ta"), F.lit(0.0)), 6).alias("total_api_call_time_config"))


# ------------------------------------------------------------------ J3 / P5
@register("failed_group_report", duckdb_with("questions") + """
, im AS (SELECT DISTINCT image_id FROM questions WHERE question IS NOT NULL AND length(question) > 0)
SELECT image_id FROM im WHERE (image_id % 13) NOT IN (SELECT DISTINCT label FROM embeddings)""")
def q_failed_group_report(spark, sf):
    q = E.non_empty_questions(tb.questions(spark, sf))
    imgs = q.select("image_id", (F.col("image_id") % N_GROUPS_IMG).cast("bigint").alias(G)).distinct()
    pruned = tb.tokens(spark, sf).select(G).distinct()
    return E.failed_group_report(imgs, pruned, [G]).select("image_id")


@register("skip_failed_groups", duckdb_with("questions") + """
SELECT question_id FROM questions WHERE question IS NOT NULL AND length(question) > 0
  AND (image_id % 13) IN (SELECT DISTINCT label FROM embeddings)""")
def q_skip_failed_groups(spark, sf):
    q = E.non_empty_questions(tb.questions(spark, sf)).select(
        "question_id", (F.col("image_id") % N_GROUPS_IMG).cast("bigint").alias(G))
    return E.skip_failed_groups(q, tb.tokens(spark, sf), [G]).select("question_id")


# ------------------------------------------------------------------ J4
@register("positional_join", duckdb_with("mc_items") + """
, a AS (SELECT idx, row_number() OVER (ORDER BY idx) AS i FROM mc_items)
, b AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS i FROM pages)
SELECT a.idx, b.page_id, b.url FROM a JOIN b USING (i)""")
def q_positional_join(spark, sf):
    a = E.global_row_number(tb.mc_items(spark, sf).select("idx"), "idx", "i")
    b = E.global_row_number(tb.raw(spark, sf, "pages").select("page_id", "url"), "page_id", "i")
    return a.join(b, "i").select("idx", "page_id", "url")


# ------------------------------------------------------------------ A1 / A2 / A3 / A5
@register("group_questions", duckdb_with("questions") + """
SELECT image_id, count(*) AS questions_used_for_pruning FROM questions
WHERE question IS NOT NULL AND length(question) > 0 GROUP BY 1""")
def q_group_questions(spark, sf):
    return E.group_questions(tb.questions(spark, sf), "image_id", "turn").select("image_id", "questions_used_for_pruning")


@register("combined_guidance", duckdb_with("questions") + """
SELECT image_id, string_agg(question, ' ' ORDER BY turn) AS combined_guidance FROM questions
WHERE question IS NOT NULL AND length(question) > 0 GROUP BY 1""")
def q_combined_guidance(spark, sf):
    return E.group_questions(tb.questions(spark, sf), "image_id", "turn").select("image_id", "combined_guidance")


@register("first_payload", duckdb_with("questions") + """
SELECT image_id, octet_length(arg_min(encode(question), turn))::BIGINT AS first_payload_bytes FROM questions
WHERE question IS NOT NULL AND length(question) > 0 GROUP BY 1""")
def q_first_payload(spark, sf):
    q = tb.questions(spark, sf).withColumn("payload", F.col("question").cast("binary"))
    g = E.group_questions(q, "image_id", "turn", payload="payload")
    return g.select("image_id", F.octet_length("first_payload").cast("bigint").alias("first_payload_bytes"))


@register("unique_groups", duckdb_with("questions") + """
SELECT count(DISTINCT image_id) AS unique_images FROM questions""")
def q_unique_groups(spark, sf):
    return tb.questions(spark, sf).agg(F.count_distinct("image_id").alias("unique_images"))


# ------------------------------------------------------------------ A4
@register("group_sizes_top10", duckdb_with("questions") + """
SELECT image_id, count(*) AS n_questions FROM questions GROUP BY 1 ORDER BY n_questions DESC, image_id LIMIT 10""")
def q_group_sizes_top10(spark, sf):
    return E.group_sizes_top(tb.questions(spark, sf), "image_id", 10)


# ------------------------------------------------------------------ A6
@register("amortised_embed_time", duckdb_with("questions") + """
, q AS (SELECT * FROM questions WHERE question IS NOT NULL AND length(question) > 0)
, c AS (SELECT image_id, sum(length(question)) / 10000.0 AS cost, count(*) AS k FROM q GROUP BY 1)
SELECT question_id, round(cost / k, 9) AS amortised_cost FROM q JOIN c USING (image_id)""")
def q_amortised_embed_time(spark, sf):
    q = E.non_empty_questions(tb.questions(spark, sf))
    cost = q.groupBy("image_id").agg((F.sum(F.length("question")) / 10000.0).alias("cost"))
    rows = q.join(cost, "image_id")
    a = E.amortised_cost(rows, ["image_id"], "cost")
    return a.select("question_id", F.round("amortised_cost", 9).alias("amortised_cost"))
